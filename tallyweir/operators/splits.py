"""Cross-validation splits as tables. Membership is arithmetic on obs_no: no range join."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import SPLIT, ResearchPolicy


def observations(panel: DataFrame) -> DataFrame:
    """panel_id, n_obs: a row per panel."""
    return panel.groupBy("panel_id").agg((F.max("obs_no") + 1).alias("n_obs"))


def _count(p: ResearchPolicy) -> Column:
    """Walk-forward splits of n_obs observations."""
    room = F.col("n_obs") - p.min_train - p.test
    return F.when(room >= 0, F.floor(room / p.step) + 1).otherwise(0)


def _id(k: Column, prefix: str) -> Column:
    return F.format_string(prefix + "%03d", k)


def walk_forward(panel: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """panel_id, split_no, split_id, start: the train window is [0, start), the test window [start, start + test)."""
    k = observations(panel).withColumn("k", _count(p)).filter("k > 0").withColumn("split_no", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    return k.select("panel_id", "split_no", _id(F.col("split_no"), "WF").alias("split_id"), (F.lit(p.min_train) + F.col("split_no") * p.step).cast("long").alias("start"))


def walk_forward_rows(panel: DataFrame, role: str, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """The panel's rows once for each walk-forward split whose train or test window they are in."""
    o = F.col("obs_no")
    if role == "test":
        lo, hi = F.ceil((o - p.min_train - p.test + 1) / p.step), F.floor((o - p.min_train) / p.step)
    else:
        lo, hi = F.floor((o - p.min_train) / p.step) + 1, F.col("k") - 1
    lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.col("k") - 1).cast("int")
    rows = panel.join(observations(panel).select("panel_id", _count(p).alias("k")), "panel_id").withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi")
    return rows.withColumn("split_no", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "k").withColumn("split_id", _id(F.col("split_no"), "WF"))


def max_paths(p: ResearchPolicy, rules: int) -> int:
    """How many combinations the budget allows: whole rounds of the rules, but one at least."""
    return max(1, p.parameter_budget // max(rules, 1) * rules)


def _folds(p: ResearchPolicy) -> list[tuple[Column, Column]]:
    """First and last observation of each fold, as equal as can be, the first ones longer. n_obs is a column."""
    base, extra = F.floor(F.col("n_obs") / p.folds), F.col("n_obs") % p.folds
    low = lambda b: base * b + F.least(F.lit(b), extra)
    return [(low(b), low(b + 1) - 1) for b in range(p.folds)]


def segments(panel: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """panel with segment: fold, and a bit for every fold of which the observation is part or within the embargo. Observations of a segment train and test together."""
    o = F.col("obs_no")
    folds = _folds(p)
    own = sum((F.when((o >= lo) & (o <= hi), b).otherwise(0) for b, (lo, hi) in enumerate(folds)), F.lit(0))
    near = sum((F.when((lo <= hi) & (o >= lo - p.embargo) & (o <= hi + p.embargo), 1 << b).otherwise(0) for b, (lo, hi) in enumerate(folds)), F.lit(0))
    rows = panel.join(observations(panel), "panel_id")
    return rows.withColumn("segment", (own * 2**p.folds + near).cast("long")).select(*panel.columns, "segment")


def splits_of_segments(panel: DataFrame, p: ResearchPolicy = ResearchPolicy(), rules: int = 6) -> DataFrame:
    """SPLIT, segment, role, n_train, skipped: the segments each combination trains and tests on, a few per panel and split.

    A split whose train window stays below min_train is left out; skipped_splits() counts those.
    """
    kept = _combined(panel, p, rules)
    return kept.filter(F.col("n_train") >= p.min_train).drop("n_train")


def skipped_splits(panel: DataFrame, p: ResearchPolicy = ResearchPolicy(), rules: int = 6) -> DataFrame:
    """panel_id, n_splits, n_skipped: combinations within the budget, and those whose train window is too short."""
    per = _combined(panel, p, rules).groupBy(*SPLIT).agg(F.max("n_train").alias("n_train"))
    return per.groupBy("panel_id").agg(F.count("*").alias("n_splits"), F.count_if(F.col("n_train") < p.min_train).alias("n_skipped"))


def _combined(panel: DataFrame, p: ResearchPolicy, rules: int) -> DataFrame:
    sizes = segments(panel.select("panel_id", "obs_no").distinct(), p).groupBy("panel_id", "segment").agg(F.count("*").alias("n"))
    combos = list(combinations(range(p.folds), p.test_folds))[: max_paths(p, rules)]
    own, near = F.floor(F.col("segment") / 2**p.folds), F.col("segment") % 2**p.folds
    cases = [F.struct(F.lit(k).alias("split_no"), F.when(own.isin(*combo), "test").when(near.bitwiseAND(sum(1 << b for b in combo)) == 0, "train").alias("role")) for k, combo in enumerate(combos)]
    rows = sizes.withColumn("s", F.explode(F.array(*cases))).filter("s.role is not null").select("panel_id", "s.split_no", _id(F.col("s.split_no"), "CPCV").alias("split_id"), "segment", "s.role", "n")
    n_train = F.coalesce(F.sum(F.when(F.col("role") == "train", F.col("n"))).over(Window.partitionBy(*SPLIT)), F.lit(0))
    return rows.withColumn("n_train", n_train).drop("n")


def purged(panel: DataFrame, p: ResearchPolicy = ResearchPolicy(), rules: int = 6) -> DataFrame:
    """Combinatorial purged splits: the panel's rows once per split they train or test in, with role.

    Train rows within embargo of a test fold are left out, and so are splits whose train window stays below min_train.
    """
    used = splits_of_segments(panel, p, rules)
    return segments(panel, p).join(used, ["panel_id", "segment"]).select(*panel.columns, "split_no", "split_id", "role")


def membership(rows: DataFrame) -> DataFrame:
    """Per split and role: observations, first, last and sum of obs_no."""
    obs = rows.select(*SPLIT, "role", "obs_no").distinct()
    return obs.groupBy("split_id", "role").agg(F.count("*").alias("n_obs"), F.min("obs_no").alias("first_obs"), F.max("obs_no").alias("last_obs"), F.sum("obs_no").alias("sum_obs"))


def disjoint(rows: DataFrame) -> DataFrame:
    """Per split: observations in both roles (must be 0), and whether all training comes first."""
    obs = rows.select(*SPLIT, "role", "obs_no").distinct()
    both = obs.groupBy(*SPLIT, "obs_no").agg(F.count("*").alias("roles"), F.min("role").alias("role"))
    train, test = F.when(F.col("role") == "train", F.col("obs_no")), F.when(F.col("role") == "test", F.col("obs_no"))
    return both.groupBy("split_id").agg(F.sum((F.col("roles") > 1).cast("int")).cast("long").alias("n_shared"), (F.max(train) < F.min(test)).alias("train_first"))
