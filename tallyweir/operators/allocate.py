"""Allocation rules for every split at once: SPLIT, challenger, asset, weight, status, method, message."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import EPS, SPLIT, TAIL, TRADING_DAYS, VOL_FLOOR
from ..sources.scratch import materialize
from . import risk, simplex

FLOOR = VOL_FLOOR / TRADING_DAYS**0.5


def _as_rule(df: DataFrame, challenger: str, method: str) -> DataFrame:
    for c, v in (("status", "OK"), ("message", "")):
        df = df if c in df.columns else df.withColumn(c, F.lit(v))
    return df.select(*SPLIT, F.lit(challenger).alias("challenger"), "asset", "weight", "status", F.lit(method).alias("method"), "message")


def equal_weight(cov: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    own = Window.partitionBy(*SPLIT)
    return _as_rule(risk.volatility(cov).withColumn("weight", 1.0 / F.count("*").over(own)), "equal_weight", "CLOSED_FORM")


def inverse_volatility(cov: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Weights by 1 / volatility, floored; message lists the floored assets."""
    own = Window.partitionBy(*SPLIT)
    inv = risk.volatility(cov).withColumn("inv", 1 / F.greatest("vol", F.lit(FLOOR)))
    floored = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("vol") < FLOOR, F.col("asset"))).over(own)))
    missing = F.max((F.col("vol").isNull() | F.isnan("vol")).cast("int")).over(own)
    out = inv.withColumn("message", F.when(missing > 0, "MISSING_VOLATILITY").otherwise(floored)).withColumn("status", F.when(missing > 0, "NOT_EVALUABLE").otherwise("OK"))
    return _as_rule(out.withColumn("weight", F.when(F.col("status") == "OK", F.col("inv") / F.sum("inv").over(own))), "inverse_volatility", "CLOSED_FORM")


def leaf_order(pairs: list[tuple[str, str, float]]) -> list[str]:
    """Single-linkage leaves from left to right. Pairs merge by (distance, a, b); the cluster made first stands left."""
    names = sorted({a for a, _, _ in pairs})
    cluster = {a: i for i, a in enumerate(names)}
    leaves = {i: [a] for i, a in enumerate(names)}
    for _, a, b in sorted((d, a, b) for a, b, d in pairs if a < b):
        x, y = sorted((cluster[a], cluster[b]))
        if x != y:
            new = len(names) + len(leaves)
            while new in leaves:
                new += 1
            leaves[new] = leaves.pop(x) + leaves.pop(y)
            for leaf in leaves[new]:
                cluster[leaf] = new
    return next(iter(leaves.values())) if leaves else []


def spanning_forest(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The pairs that single linkage merges by, in the order of (distance, a, b), and each asset with itself."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    kept = [(a, b, d) for a, b, d in pairs if a == b]
    for d, a, b in sorted((d, a, b) for a, b, d in pairs if a < b):
        x, y = top(a), top(b)
        if x != y:
            above[x] = y
            kept.append((a, b, d))
    return kept


def merging_pairs(dist: DataFrame, side: int = 256) -> DataFrame:
    """The pairs of dist (SPLIT, a, b, dist) among which those are by which single linkage merges: all of a split's, or few of many.

    Assets are hashed to parts of about side; the pairs of two parts give the forest that spans them, and every merge of the whole is one of such a
    forest. So what meets in a split's one task grows with the assets, not with their square.
    """
    sizes = dist.filter("a = b").groupBy(*SPLIT).agg(F.ceil(F.count("*") / side).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    dealt = dist.filter("a <= b").join(sizes, SPLIT).select(*SPLIT, "a", "b", "dist", part("a").alias("i"), part("b").alias("j"))
    types = {f.name: f.dataType.simpleString() for f in dist.schema.fields}

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = spanning_forest(list(zip(pdf["a"], pdf["b"], pdf["dist"], strict=True)))
        out = pd.DataFrame(kept, columns=["a", "b", "dist"])
        return out.assign(**{k: pdf[k].iloc[0] for k in SPLIT})[[*SPLIT, "a", "b", "dist"]]

    return dealt.groupBy(*SPLIT, F.least("i", "j"), F.greatest("i", "j")).applyInPandas(forest, ", ".join(f"{k} {types[k]}" for k in SPLIT) + ", a string, b string, dist double")


def cluster_variance(cov: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variance of the inverse-variance portfolio of each cluster (keys incl. SPLIT, asset)."""
    diag = cov.filter("a = b").select(*SPLIT, F.col("a").alias("asset"), (1 / F.greatest("cov", F.lit(EPS))).alias("iv"))
    ivp = clusters.join(diag, [*SPLIT, "asset"]).withColumn("d", F.col("iv") / F.sum("iv").over(Window.partitionBy(*keys)))
    floor = cov.withColumn("cov", F.when(F.col("a") == F.col("b"), F.greatest("cov", F.lit(EPS))).otherwise(F.col("cov")))
    return risk.quadratic(ivp, floor, keys).withColumnRenamed("q", "variance")


def hierarchical_risk_parity(cov: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Leaf order per split from the pairs that merge, in a small grouped function, then relational bisection: a round per level, all splits at once.

    Splits with a covariance that is no number are NOT_EVALUABLE.
    """
    odd = cov.filter(F.col("cov").isNull() | F.isnan("cov")).select(*SPLIT).distinct()
    closed = cov.filter(F.col("a") == F.col("b")).join(odd, SPLIT, "left_semi").select(*SPLIT, F.col("a").alias("asset"), F.lit(None).cast("double").alias("weight"), F.lit("NOT_EVALUABLE").alias("status"), F.lit("NON_FINITE_COVARIANCE").alias("message"))
    cov = cov.join(odd, SPLIT, "left_anti")
    dist = risk.correlation(cov)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = leaf_order(list(zip(pdf["a"], pdf["b"], pdf["dist"], strict=True)))
        k = pdf.iloc[0]
        return pd.DataFrame({"panel_id": k["panel_id"], "split_no": k["split_no"], "split_id": k["split_id"], "asset": leaves, "pos": range(len(leaves))})

    types = {f.name: f.dataType.simpleString() for f in dist.schema.fields}
    placed = merging_pairs(dist).groupBy(*SPLIT).applyInPandas(order, ", ".join(f"{k} {types[k]}" for k in SPLIT) + ", asset string, pos int")
    state = materialize(placed.withColumn("weight", F.lit(1.0)).withColumn("lo", F.lit(0)).withColumn("hi", F.count("*").over(Window.partitionBy(*SPLIT)).cast("int")), "hrp")
    while not state.filter("hi - lo > 1").isEmpty():
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        halves = state.withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, mid).otherwise(F.col("hi"))).withColumn("side", (F.col("pos") >= F.col("mid")).cast("int"))
        v = cluster_variance(cov, halves, [*SPLIT, "lo", "side"]).groupBy(*SPLIT, "lo").agg(F.max(F.when(F.col("side") == 0, F.col("variance"))).alias("vl"), F.max(F.when(F.col("side") == 1, F.col("variance"))).alias("vr"))
        alpha = F.when(F.col("vr").isNull(), 1.0).otherwise(1 - F.col("vl") / F.greatest(F.col("vl") + F.col("vr"), F.lit(EPS)))
        part = F.when(F.col("side") == 0, F.col("alpha")).otherwise(1 - F.col("alpha"))
        state = materialize(halves.join(v, [*SPLIT, "lo"]).withColumn("alpha", alpha).select(*SPLIT, "asset", "pos", (F.col("weight") * part).alias("weight"), F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("side") == 0, F.col("mid")).otherwise(F.col("hi")).alias("hi")), "hrp")
    return _as_rule(state, "hierarchical_risk_parity", "SINGLE_LINKAGE").unionByName(_as_rule(closed, "hierarchical_risk_parity", "SINGLE_LINKAGE"), allowMissingColumns=True)


def _wide(rows: DataFrame) -> DataFrame:
    """SPLIT, obs_no, r: returns in asset order."""
    return rows.groupBy(*SPLIT, "obs_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "ret"))), lambda x: x["ret"]).alias("r"))


def _own(df: DataFrame, *more: str) -> list[str]:
    """The keys of an incumbent: SPLIT, and start where a split has several."""
    return [*SPLIT, *(["start"] if "start" in df.columns else []), *more]


def candidates(incumbent: DataFrame) -> DataFrame:
    """For incumbents (SPLIT, h, w in asset order): themselves (0, 0) and all transfers of h, or of what there is, from one asset to another: i, j, w."""
    n = F.size("w")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    out = incumbent.withColumn("p", F.explode(F.filter(pairs, lambda p: (p["i"] != p["j"]) | (p["i"] == 1)))).withColumn("i", F.when(F.col("p.i") == F.col("p.j"), 0).otherwise(F.col("p.i"))).withColumn("j", F.when(F.col("i") == 0, 0).otherwise(F.col("p.j")))
    out = out.filter((F.col("i") == 0) | (F.element_at("w", F.greatest("i", F.lit(1))) > 0))
    out = out.withColumn("step", F.least("h", F.element_at("w", F.greatest("i", F.lit(1)))))
    moved = F.transform("w", lambda x, k: x + F.when(k + 1 == F.col("j"), F.col("step")).when(k + 1 == F.col("i"), -F.col("step")).otherwise(0.0))
    return out.select(*_own(incumbent, "h", "i", "j"), moved.alias("w"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score_cdar(cands: DataFrame, wide: DataFrame) -> DataFrame:
    keys = _own(cands, "h", "i", "j")
    path = risk.drawdown_path(cands.join(wide, SPLIT).select(*keys, "obs_no", _dot("w", "r").alias("ret")), keys)
    return risk.tail_mean(path, keys, -F.col("drawdown"), "score").drop("q")


def _searched(cov: DataFrame, rows: DataFrame, score, challenger: str, **how) -> DataFrame:
    """The end of a search that starts from equal or inverse-volatility weights; message holds what it reached."""
    ready = inverse_volatility(cov).filter("status = 'OK'").groupBy(*SPLIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "weight"))), lambda x: x["weight"]).alias("w"))
    ends = simplex.searched(rows, ready, score, **how)
    message = F.when(F.col("status") == "OK", F.concat(F.lit("objective="), F.format_string("%.12g", "score"), F.lit(";rounds="), F.col("rounds").cast("string"))).otherwise(F.lower("status"))
    return _as_rule(ends.withColumn("message", message), challenger, "PAIR_TRANSFER_SEARCH")


def risk_budget_cvar(cov: DataFrame, rows: DataFrame, **how) -> DataFrame:
    return _searched(cov, rows, lambda r: simplex.cvar_budget, "risk_budget_cvar", **({"every_start": True} | how))


def min_cdar(cov: DataFrame, rows: DataFrame, **how) -> DataFrame:
    return _searched(cov, rows, lambda r: simplex.cdar, "min_cdar", **how)


def shrunk_mean_risk(cov: DataFrame, rows: DataFrame, **how) -> DataFrame:
    return _searched(cov, rows, lambda r: simplex.mean_risk(*simplex.shrunk_inputs(r)), "shrunk_mean_risk", **how)


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "equal_weight": equal_weight, "inverse_volatility": inverse_volatility, "hierarchical_risk_parity": hierarchical_risk_parity,
    "risk_budget_cvar": risk_budget_cvar, "min_cdar": min_cdar, "shrunk_mean_risk": shrunk_mean_risk,
}


def build(name: str, cov: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """The allocations of a registered rule; cov and rows are those of the train windows."""
    if name not in REGISTRY:
        raise KeyError(f"UNKNOWN_CHALLENGER:{name}")
    return REGISTRY[name](cov, rows, **how)
