"""Gates: checks that end in a status, never in a silently smaller table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import EPS, ResearchPolicy
from ..sources.scratch import materialize

_P = ResearchPolicy()


class ResearchClosed(RuntimeError):
    """A broken invariant ends the run."""


def panel_gate(panel: DataFrame, as_of: str, minimum: int = _P.min_train + _P.test, expected: list[str] | None = None) -> DataFrame:
    """panel_id, gate_status: the first failing check of each panel, or PASS.

    expected names panels that must be there: one without rows is too narrow, it does not vanish. A row without a date fails its panel,
    and so does an obs_no, where the panel has one, that does not rise with the dates. minimum: by default a train and a test window.
    """
    cells = panel.groupBy("panel_id", "dt", "asset").agg(F.count("*").alias("c"), F.max((F.col("ret").isNull() | F.isnan("ret") | F.abs("ret").isin(float("inf"))).cast("int")).alias("bad"), F.max(F.abs("ret")).alias("most"))
    facts = cells.groupBy("panel_id").agg(F.count_distinct("asset").alias("assets"), F.count_distinct("dt").alias("dates"), F.max("dt").alias("last"), F.max("c").alias("copies"), F.count("*").alias("cells"), F.max("bad").alias("bad"), F.max("most").alias("most"), F.count_if(F.col("dt").isNull()).alias("undated"))
    facts = facts.withColumn("unordered", F.lit(False))
    if "obs_no" in panel.columns:
        days = panel.filter("dt is not null").groupBy("panel_id", "obs_no").agg(F.min("dt").alias("dt"), F.max("dt").alias("until"))
        later = days.select("panel_id", (F.col("obs_no") - 1).alias("obs_no"), F.col("dt").alias("following"))
        order = days.join(later, ["panel_id", "obs_no"], "left").groupBy("panel_id").agg(F.max((F.col("dt") < F.col("until")) | F.coalesce(F.col("following") <= F.col("until"), F.lit(False))).alias("odd"))
        facts = facts.join(order, "panel_id", "left").withColumn("unordered", F.coalesce("odd", F.lit(False))).drop("odd")
    if expected is not None:
        names = panel.sparkSession.createDataFrame([(x,) for x in expected], "panel_id string")
        facts = names.join(facts, "panel_id", "full")
    status = (F.when((F.coalesce("dates", F.lit(0)) == 0) | (F.col("assets") < 2), "RETURN_PANEL_EMPTY_OR_TOO_NARROW")
              .when(F.col("dates") < minimum, F.concat(F.lit("INSUFFICIENT_HISTORY:"), F.col("dates").cast("string"), F.lit(f"<{minimum}")))
              .when(F.col("last").isNull() | (F.col("undated") > 0), "INDEX_NOT_DATETIME").when(F.col("unordered"), "RETURN_INDEX_NOT_STRICTLY_INCREASING").when(F.col("copies") > 1, "DUPLICATE_ASSET_COLUMNS")
              .when(F.col("last") > F.lit(as_of).cast("date"), "AS_OF_VIOLATION").when((F.col("bad") > 0) | (F.col("cells") < F.col("dates") * F.col("assets")), "NON_FINITE_RETURN")
              .when(F.col("most") >= 1, "IMPLAUSIBLE_DAILY_RETURN").otherwise("PASS"))
    return facts.select("panel_id", status.alias("gate_status"))


def require(gate: DataFrame) -> None:
    """Raises unless there is a panel and every panel passes. One job, of which one row comes to the driver."""
    n, bad = gate.agg(F.count("*"), F.min(F.when(F.col("gate_status") != "PASS", F.struct("panel_id", "gate_status")))).first()
    if not n:
        raise ResearchClosed("RETURN_PANEL_EMPTY_OR_TOO_NARROW")
    if bad:
        raise ResearchClosed(f"{bad['panel_id']}: {bad['gate_status']}")


def quarantined(panel: DataFrame, gate: DataFrame) -> DataFrame:
    """The rows of the panels that pass; the others keep their status in the gate's table and in the trace."""
    return panel.join(gate.filter("gate_status = 'PASS'").select("panel_id"), "panel_id", "left_semi")


def require_budget(rules: list[str], p: ResearchPolicy) -> None:
    if len(rules) > p.parameter_budget:
        raise ResearchClosed("PARAMETER_BUDGET_EXCEEDED")


def require_status(rows: DataFrame, passes: Column, code: str) -> None:
    """Raises code if a row does not pass; one row comes to the driver."""
    if not rows.filter(~F.coalesce(passes, F.lit(False))).isEmpty():
        raise ResearchClosed(code)


def next_tradable(times: DataFrame, calendar: DataFrame, by: list[str] | None = None) -> DataFrame:
    """times (by, dt) with next_dt, the least dt of the calendar (by, dt) of the same keys after it, and status. dt: dates or timestamps.

    Both sides are dealt by range of (by, dt) together. A partition answers from its own rows; where its calendar ends too early, the first
    calendar time of a later partition counts, of which there is one row a partition and key. Repeated rows are answered each; a null dt or key has no next time.
    """
    keys = by or []
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    both = times.select(*keys, "dt", micros("dt").alias("t"), F.lit(None).cast(calendar.schema["dt"].dataType).alias("c")).unionByName(
        calendar.select(*keys, F.lit(None).cast(times.schema["dt"].dataType).alias("dt"), micros("dt").alias("t"), F.col("dt").alias("c")))
    parts = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(both.repartitionByRange(parts, *keys, "t").withColumn("part", F.spark_partition_id()), "as_of")
    own = Window.partitionBy(*keys, "part").orderBy("t").rangeBetween(1, Window.unboundedFollowing)
    local = dealt.withColumn("near", F.min("c").over(own)).filter("c is null")
    heads = dealt.filter("c is not null").groupBy(*keys, "part").agg(F.min("c").alias("head"))
    seen = dealt.select(*keys, "part").distinct().join(heads, [*keys, "part"], "left")
    later = seen.withColumn("far", F.min("head").over(Window.partitionBy(*keys or [F.lit(1)]).orderBy("part").rowsBetween(1, Window.unboundedFollowing))).select(*keys, "part", "far")
    out = local.join(later, [*keys, "part"], "left").withColumn("next_dt", F.when(F.col("t").isNotNull(), F.coalesce("near", "far")))
    return out.select(*keys, "dt", "next_dt", F.when(F.col("next_dt").isNull(), "NO_NEXT_TRADABLE_TIME").otherwise("OK").alias("status"))


def normalize_long_only(weights: DataFrame, keys: list[str]) -> DataFrame:
    """weights (keys, asset, weight) with status; OK groups sum to one, failed ones have null weights."""
    own = Window.partitionBy(*keys)
    w = F.col("weight")
    odd = F.max((w.isNull() | F.isnan(w) | F.abs(w).isin(float("inf"))).cast("int")).over(own)
    total = F.sum(F.greatest(w, F.lit(0.0))).over(own)
    status = F.when(odd > 0, "NON_FINITE_WEIGHT").when(F.min("weight").over(own) < -1e-10, "SHORT_WEIGHT_PROPOSED").when(total <= EPS, "ALL_CASH_OR_ZERO_WEIGHT_PROPOSAL").otherwise("OK")
    out = weights.withColumn("status", status).withColumn("weight", F.when(F.col("status") == "OK", F.greatest(w, F.lit(0.0)) / total))
    missed = (F.col("status") == "OK") & ~(F.abs(F.sum("weight").over(own) - 1) <= 1e-10)
    return out.withColumn("status", F.when(missed, "WEIGHT_NORMALIZATION_FAILED").otherwise(F.col("status"))).withColumn("weight", F.when(F.col("status") == "OK", F.col("weight")))


def align_weights(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """panel_id, asset, weight, status over the universe: missing (or NaN) is 0, assets outside vanish, the last of duplicates counts (row_id).

    Weights with a panel_id are that panel's, weights without one go to every panel.
    """
    keys = [c for c in ("panel_id", "asset") if c in weights.columns]
    last = weights.withColumn("weight", F.nanvl("weight", F.lit(None).cast("double"))).groupBy(*keys).agg(F.max_by(F.struct("weight"), "row_id").alias("w")).select(*keys, "w.weight")
    full = universe.select("panel_id", "asset").distinct().join(last, keys, "left").select("panel_id", "asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return normalize_long_only(full, ["panel_id"])


def drift_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """weights (panel_id, asset, weight) after one period's returns (panel_id, asset, ret), with status."""
    own = Window.partitionBy("panel_id")
    joined = weights.join(returns, ["panel_id", "asset"], "left").withColumn("grown", F.col("weight") * (1 + F.col("ret")))
    nan = lambda c: F.col(c).isNull() | F.isnan(c)
    missing, odd, total = F.max(nan("ret")).over(own), F.max(nan("weight")).over(own), F.sum("grown").over(own)
    status = F.when(missing, "MISSING_EXECUTION_RETURN").when(odd, "NON_FINITE_WEIGHT").when(total <= EPS, "DRIFTED_PORTFOLIO_NON_POSITIVE").otherwise("OK")
    return joined.withColumn("status", status).select("panel_id", "asset", F.when(F.col("status") == "OK", F.col("grown") / total).alias("weight"), "status")
