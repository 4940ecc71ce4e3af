"""Constraints, two return paths, evaluation rows and the evidence drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import SPLIT, ResearchPolicy
from . import evidence, risk, splits

RULE = [*SPLIT, "challenger"]


def _beside(target: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """target with the other weights of its panel as name: each rule gets the assets of both, 0 where one side lacks them."""
    rules = target.select(*RULE).distinct().join(other.select("panel_id", "asset", F.col("weight").alias(name)), "panel_id")
    return target.join(rules, [*RULE, "asset"], "full").withColumn(name, F.coalesce(name, F.lit(0.0)))


def cap_tracking_error(target: DataFrame, bench: DataFrame, cov: DataFrame, cap: float) -> DataFrame:
    """RULE, asset, raw, bench, weight, te_before, te_after, te_binding: the target drawn to the benchmark until its error is cap.

    The error is linear on that line, so the scale is cap / error.
    """
    both = _beside(target.select(*RULE, "asset", F.col("weight").alias("raw")), bench, "bench").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    te = risk.tracking_error(both.withColumn("d", F.col("raw") - F.col("bench")), cov, RULE)
    s = F.when(F.col("te") > cap, cap / F.col("te")).otherwise(1.0)
    return both.join(te, RULE).select(*RULE, "asset", "raw", "bench", (F.col("bench") + s * (F.col("raw") - F.col("bench"))).alias("weight"), F.col("te").alias("te_before"), F.least("te", F.lit(cap)).alias("te_after"), (F.col("te") > cap).alias("te_binding"))


def cap_turnover(requested: DataFrame, previous: DataFrame, cap: float) -> DataFrame:
    """requested with previous, weight (moved from previous no further than cap), turnover_requested, turnover, turnover_binding."""
    own = Window.partitionBy(*RULE)
    both = _beside(requested, previous, "previous")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("raw", "bench", "weight") if c in both.columns})
    both = both.withColumns({c: F.max(c).over(own) for c in ("te_before", "te_after", "te_binding") if c in both.columns})
    both = both.withColumn("turnover_requested", F.sum(F.abs(F.col("weight") - F.col("previous"))).over(own) / 2)
    s = F.when(F.col("turnover_requested") > cap, cap / F.col("turnover_requested")).otherwise(1.0)
    moved = both.withColumn("weight", F.col("previous") + s * (F.col("weight") - F.col("previous"))).withColumn("weight", F.col("weight") / F.sum("weight").over(own))
    return moved.withColumn("turnover", F.sum(F.abs(F.col("weight") - F.col("previous"))).over(own) / 2).withColumn("turnover_binding", F.col("turnover_requested") > cap)


def constrained(allocations: DataFrame, bench: DataFrame, previous: DataFrame, cov: DataFrame, p: ResearchPolicy) -> DataFrame:
    """Both caps in turn, over the OK allocations. Every split starts from the same previous weights."""
    te = cap_tracking_error(allocations.filter("status = 'OK'"), bench, cov, p.te_cap)
    return cap_turnover(te, previous, p.turnover_cap)


def constraint_diagnostics(held: DataFrame) -> DataFrame:
    """RULE with L1 distances of raw and final weights to the benchmark, binding constraints and a cost proxy."""
    caps = [F.max(c).alias(c) for c in ("te_before", "te_after", "te_binding", "turnover_requested", "turnover", "turnover_binding") if c in held.columns]
    names = F.concat_ws(";", F.array_compact(F.array(F.when(F.max("te_binding"), F.lit("TRACKING_ERROR")), F.when(F.max("turnover_binding"), F.lit("TURNOVER")))))
    return held.groupBy(*RULE).agg(F.sum(F.abs(F.col("raw") - F.col("bench"))).alias("raw_l1"), F.sum(F.abs(F.col("weight") - F.col("bench"))).alias("constrained_l1"), F.coalesce(F.nullif(names, F.lit("")), F.lit("NONE")).alias("binding_constraints"), F.sum(F.abs(F.col("raw") - F.col("weight"))).alias("cost_proxy"), *caps)


def conserved(held: DataFrame, bench: DataFrame, cov: DataFrame, p: ResearchPolicy) -> DataFrame:
    """RULE, status: both caps measured again on the weights themselves, the tracking error on those before the turnover cap."""
    scale = F.when(F.col("te_before") > p.te_cap, p.te_cap / F.col("te_before")).otherwise(1.0)
    d = held.select(*RULE, "asset", (scale * (F.col("raw") - F.col("bench"))).alias("d"))
    te = risk.tracking_error(d, cov, RULE)
    moved = held.groupBy(*RULE).agg((F.sum(F.abs(F.col("weight") - F.col("previous"))) / 2).alias("moved"), F.sum("weight").alias("total"))
    status = F.when(~(F.col("te") <= p.te_cap + 1e-8), "TRACKING_ERROR_CAP_NOT_CONSERVED").when(~(F.col("moved") <= p.turnover_cap + 1e-9), "TURNOVER_CAP_NOT_CONSERVED").when(~(F.abs(F.col("total") - 1) <= 1e-10), "WEIGHT_NORMALIZATION_FAILED").otherwise("OK")
    return moved.join(te, RULE).select(*RULE, status.alias("status"))


def portfolio_returns(held: DataFrame, rows: DataFrame) -> DataFrame:
    """RULE, obs_no, dt, ret: the weighted sum of each day."""
    j = rows.select(*SPLIT, "obs_no", "dt", "asset", "ret").join(held.select(*RULE, "asset", "weight"), [*SPLIT, "asset"])
    return j.groupBy(*RULE, "obs_no", "dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def portfolio_returns_folded(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The same by another way: a day's rows in asset order, folded."""
    j = rows.select(*SPLIT, "obs_no", "dt", "asset", "ret").join(held.select(*RULE, "asset", "weight"), [*SPLIT, "asset"])
    day = j.groupBy(*RULE, "obs_no", "dt").agg(F.array_sort(F.collect_list(F.struct("asset", "ret", "weight"))).alias("x"))
    return day.select(*RULE, "obs_no", "dt", F.aggregate("x", F.lit(0.0), lambda s, e: s + e["ret"] * e["weight"]).alias("ret"))


def differential(one: DataFrame, two: DataFrame, tolerance: float) -> DataFrame:
    """RULE, days, worst, status: PASS if both paths agree on every day; a day that one lacks fails."""
    keys = [*RULE, "obs_no"]
    j = one.select(*keys, F.col("ret").alias("r1")).join(two.select(*keys, F.col("ret").alias("r2")), keys, "full")
    gap = F.coalesce(F.abs(F.col("r1") - F.col("r2")), F.lit(float("inf")))
    return j.groupBy(*RULE).agg(F.count("*").alias("days"), F.max(gap).alias("worst")).withColumn("status", F.when(F.col("worst") <= tolerance, "PASS").otherwise("FAIL"))


def evaluation(held: DataFrame, rows: DataFrame, p: ResearchPolicy, returns: DataFrame | None = None) -> DataFrame:
    """RULE with the performance of the test rows (compounded in date order), tracking error and turnover."""
    facts = held.groupBy(*RULE).agg(F.first("turnover").alias("turnover"), F.first("te_before").alias("te_before"), F.first("te_after").alias("te_after"), F.first("te_binding").alias("te_binding"), F.first("turnover_binding").alias("turnover_binding"))
    returns = (portfolio_returns(held, rows) if returns is None else returns).join(facts.select(*RULE, "turnover"), RULE)
    return risk.performance(returns, RULE, p.cost_bps).join(facts.drop("turnover"), RULE)


def execution(panel: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """SPLIT, decided_at (last train date), execute_at (the next date of the panel's own calendar), first_test, aligned."""
    days = panel.select("panel_id", "obs_no", "dt").distinct()
    wf = splits.walk_forward(panel, p)
    decided = wf.withColumn("obs_no", F.col("start") - 1).join(days, ["panel_id", "obs_no"]).select(*SPLIT, "start", F.col("dt").alias("decided_at"))
    first = decided.withColumn("obs_no", F.col("start")).join(days, ["panel_id", "obs_no"]).select(*SPLIT, "decided_at", F.col("dt").alias("first_test"))
    nxt = days.select("panel_id", F.col("dt").alias("decided_at"), F.lead("dt").over(Window.partitionBy("panel_id").orderBy("dt")).alias("execute_at"))
    return first.join(nxt, ["panel_id", "decided_at"], "left").withColumn("aligned", F.coalesce(F.col("execute_at") == F.col("first_test"), F.lit(False)))


def of_panels(panels: DataFrame, rules: list[str]) -> DataFrame:
    """panel_id, challenger: every rule of every panel of panels (panel_id), which may name a panel many times."""
    return panels.select("panel_id").distinct().select("panel_id", F.explode(F.array(*[F.lit(r) for r in rules])).alias("challenger"))


def report(evaluated: DataFrame, execution_: DataFrame, rows: DataFrame, allocations: DataFrame) -> DataFrame:
    """RULE, status, signal_time, execution_time, test_end and the evaluation: a row for rules that were not OK too, with nulls."""
    times = execution_.select(*SPLIT, F.col("decided_at").alias("signal_time"), F.col("execute_at").alias("execution_time"))
    ends = rows.groupBy(*SPLIT).agg(F.max("dt").alias("test_end"))
    return allocations.select(*RULE, "status").distinct().join(times, SPLIT, "left").join(ends, SPLIT, "left").join(evaluated, RULE, "left")


def challenge_matrix(evaluated: DataFrame, rules: list[str], panels: DataFrame) -> DataFrame:
    """A row per panel and rule: medians over its splits; a rule without one is NOT_EVALUABLE."""
    facts = evaluated.groupBy("panel_id", "challenger").agg(F.count("*").alias("n_splits"), *[F.median(c).alias(f"median_{c}") for c in ("cagr", "cvar", "cdar", "turnover", "te_after")], F.min("max_drawdown").alias("worst_drawdown"), F.max("turnover").alias("max_turnover"), F.every(F.col("differential_status") == "PASS").alias("all_pass"))
    out = of_panels(panels, rules).join(facts, ["panel_id", "challenger"], "left").withColumn("n_splits", F.coalesce("n_splits", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n_splits") > 0, "OK").otherwise("NOT_EVALUABLE"))


def stability(held: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """panel_id, challenger, median_l1, max_l1, share_stable, region: distances between the weights held in consecutive splits."""
    ok = held.withColumn("k", F.dense_rank().over(Window.partitionBy("panel_id", "challenger").orderBy("split_no")))
    before = F.lag("weight").over(Window.partitionBy("panel_id", "challenger", "asset").orderBy("k"))
    steps = ok.withColumn("d", F.abs(F.col("weight") - before)).groupBy("challenger", "panel_id", "k").agg(F.sum("d").alias("l1"))
    facts = steps.groupBy("panel_id", "challenger").agg(F.median("l1").alias("median_l1"), F.max("l1").alias("max_l1"), F.avg(F.when(F.col("l1").isNotNull(), (F.col("l1") <= p.stable_l1).cast("double"))).alias("share_stable"))
    none = F.col("median_l1").isNull()
    out = facts.select("panel_id", "challenger", F.when(none, 0.0).otherwise(F.col("median_l1")).alias("median_l1"), F.when(none, 0.0).otherwise(F.col("max_l1")).alias("max_l1"), F.when(none, 1.0).otherwise(F.col("share_stable")).alias("share_stable"))
    return out.withColumn("region", F.when(F.col("share_stable") >= p.stable_share, "STABLE_REGION").otherwise("UNSTABLE_REGION"))


def with_stability(matrix: DataFrame, stability_: DataFrame) -> DataFrame:
    """The matrix with each rule's stability; a rule without history is NOT_EVALUABLE there, its distances stay null."""
    out = matrix.join(stability_, ["panel_id", "challenger"], "left")
    return out.withColumn("region", F.coalesce("region", F.lit("NOT_EVALUABLE")))


def filter_trace(allocations: DataFrame, panel: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """A row per (panel, split, rule), and one per panel that its gate (panel_id, gate_status) turned away: stage, rule_id, reason, metric, threshold, observed, evidence_gap, source_ref (content hash of the panel), method, diagnostics."""
    facts = allocations.select("panel_id", "split_id", "challenger", "status", "message", "method").distinct()
    source = evidence.panel_fingerprint(panel).select("panel_id", F.col("content_hash").alias("source_ref"))
    ok = F.col("status") == "OK"
    fixed = {"stage": F.lit("CHALLENGER_BUILD"), "rule_id": F.concat(F.lit("BUILD_"), F.upper("challenger")), "metric": F.lit("solver_status"), "diagnostics": F.create_map(F.lit("message"), F.col("message"))}
    out = facts.withColumns(fixed).join(source, "panel_id", "left").select("panel_id", "split_id", "challenger", "stage", "rule_id", "metric", "source_ref", "method", "diagnostics", F.when(ok, "PASS").otherwise(F.col("status")).alias("reason"), F.lit("OK").alias("threshold"), F.col("status").alias("observed"), F.when(ok, "").otherwise(F.col("message")).alias("evidence_gap"))
    if gate is None:
        return out
    turned = gate.filter("gate_status <> 'PASS'").join(source, "panel_id", "left")
    names = {"stage": "PANEL_GATE", "rule_id": "PANEL_GATE", "metric": "gate_status", "threshold": "PASS", "evidence_gap": "panel is not researched"}
    return out.unionByName(turned.select("panel_id", "source_ref", F.col("gate_status").alias("reason"), F.col("gate_status").alias("observed"), *[F.lit(v).alias(k) for k, v in names.items()]), allowMissingColumns=True)


def rejected(trace: DataFrame, rules: list[str], panels: DataFrame) -> DataFrame:
    """Trace rows that did not pass, and a NO_AUTO_PROMOTION row per panel and rule."""
    locks = of_panels(panels, rules).withColumn("reason", F.lit("NO_AUTO_PROMOTION"))
    return trace.filter("reason <> 'PASS'").select("panel_id", "split_id", "challenger", "reason").unionByName(locks, allowMissingColumns=True)


def replay(evaluated: DataFrame, execution_: DataFrame, panel: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per OK (panel, split, rule): state, the hashes of the panel's content and universe, times, the end of the holding (with the test rows), net return and the lock."""
    frozen = evidence.panel_fingerprint(panel).select("panel_id", F.col("content_hash").alias("snapshot_hash"))
    universe = panel.groupBy("panel_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_set("asset"))), 256).alias("universe_hash"))
    out = evaluated.join(execution_.select(*SPLIT, "decided_at", "execute_at"), SPLIT).join(universe, "panel_id").join(frozen, "panel_id")
    if rows is not None:
        out = out.join(rows.groupBy(*SPLIT).agg(F.max("dt").alias("held_until")), SPLIT)
    return out.select("panel_id", "split_id", "challenger", F.lit("CLOSED_REPLAY").alias("state"), "snapshot_hash", "universe_hash", "decided_at", "execute_at", *(["held_until"] if rows is not None else []), F.col("total_return").alias("net_return"), F.lit(True).alias("no_auto_promotion"))


# Named components of the attribution; all but the cost are 0.
COMPONENTS = ["ALLOCATION_SIGNAL", "MARKET_DRIFT", "CONSTRAINT_TURNOVER_SCALING", "TRANSACTION_COST_ESTIMATE", "CASH_RETURN", "REALIZED_SHADOW_PNL", "SHADOW_CASH_FLOW"]


def attribution(held: DataFrame, rows: DataFrame, p: ResearchPolicy) -> DataFrame:
    """RULE, dt, component, value, classification, net, identity_status: one row per asset and day (weight times return) and the
    named components; the cost falls on day 0. The identity holds if the components of a day sum to its net return."""
    j = rows.join(held.select(*RULE, "asset", "weight", "turnover"), [*SPLIT, "asset"])
    assets = j.select(*RULE, "dt", F.concat(F.lit("ASSET:"), "asset").alias("component"), (F.col("weight") * F.col("ret")).alias("value"))
    days = j.select(*RULE, "dt", "turnover").distinct().withColumn("day0", F.row_number().over(Window.partitionBy(*RULE).orderBy("dt")) == 1)
    cost = F.when((F.col("component") == "TRANSACTION_COST_ESTIMATE") & F.col("day0"), -F.col("turnover") * p.cost_bps / 1e4).otherwise(0.0)
    named = days.withColumn("component", F.explode(F.array(*[F.lit(c) for c in COMPONENTS]))).select(*RULE, "dt", "component", cost.alias("value"))
    held_days = j.groupBy(*RULE, "dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    charged = held_days.join(days, [*RULE, "dt"]).select(*RULE, "dt", (F.col("gross") - F.when(F.col("day0"), F.col("turnover") * p.cost_bps / 1e4).otherwise(0.0)).alias("net"))
    out = assets.unionByName(named).join(charged, [*RULE, "dt"])
    gap = F.abs(F.sum("value").over(Window.partitionBy(*RULE, "dt")) - F.col("net"))
    kind = F.when(F.col("component").startswith("ASSET:"), "UNREALIZED_SHADOW_PNL").otherwise(F.col("component"))
    return out.withColumn("classification", kind).withColumn("identity_status", F.when(gap <= 1e-12, "PASS").otherwise("FAIL"))


def latest_targets(held: DataFrame) -> DataFrame:
    """panel_id, split_id, challenger, asset, weight of each rule's last OK split."""
    last = Window.partitionBy("panel_id", "challenger")
    return held.withColumn("last", F.max("split_no").over(last)).filter(F.col("split_no") == F.col("last")).select("panel_id", "split_id", "challenger", "asset", "weight")


def snapshot(panel: DataFrame, targets: DataFrame, bench: DataFrame, previous: DataFrame, execution_: DataFrame | None = None, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """One row per panel: universe, previous, benchmark and target weights, hashes (of the policy too), the last split's signal and next tradable date, and locks."""
    def weights(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("panel_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "weight")))).alias(name))

    facts = panel.groupBy("panel_id").agg(F.count("*").alias("n_rows"), F.max("dt").alias("as_of"), F.sha2(F.to_json(F.sort_array(F.collect_set("asset"))), 256).alias("universe_hash"))
    goal = targets.groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("challenger", "asset", "weight"))).alias("targets"))
    out = facts.join(weights(bench, "benchmark"), "panel_id").join(weights(previous, "previous"), "panel_id").join(goal, "panel_id", "left")
    if execution_ is not None:
        last = execution_.groupBy("panel_id").agg(F.max_by(F.struct("decided_at", "execute_at"), "split_no").alias("x"))
        out = out.join(last, "panel_id", "left").withColumns({"signal_date": F.col("x.decided_at"), "next_tradable": F.col("x.execute_at")}).drop("x")
    fixed = (("status", "ACTIVE_SHADOW_LOCKED"), ("policy_hash", evidence.policy_hash(p)), ("broker_connected", False), ("order_created", False), ("promoted", False))
    return out.withColumns({k: F.lit(v) for k, v in fixed})
