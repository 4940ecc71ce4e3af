"""Gates, splits, risk, allocation and constraints on hand-made frames."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import allocate, backtest, gates, risk, splits
from tallyweir.schemas import SPLIT, ResearchPolicy

DAYS = [date(2024, 1, 2) + timedelta(days=i) for i in range(400)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    rows = [("P", i, d, a, rng.gauss(0, 0.01) if a != "CASH" else 0.00008) for i, d in enumerate(DAYS) for a in ("A", "B", "C", "CASH")]
    return spark.createDataFrame(rows, "panel_id string, obs_no long, dt date, asset string, ret double").cache()


def weights(spark, kind, **w):
    return spark.createDataFrame([("P", 0, "WF000", "x", a, float(v)) for a, v in w.items()], "panel_id string, split_no int, split_id string, challenger string, asset string, weight double")


def test_next_tradable_is_strictly_later(spark):
    times = spark.createDataFrame([(DAYS[3],), (DAYS[-1],)], "dt date")
    got = {r.dt: (r.next_dt, r.status) for r in gates.next_tradable(times, spark.createDataFrame([(d,) for d in DAYS], "dt date")).collect()}
    assert got == {DAYS[3]: (DAYS[4], "OK"), DAYS[-1]: (None, "NO_NEXT_TRADABLE_TIME")}


@pytest.mark.parametrize(("change", "as_of", "status"), [
    (lambda p: p, "2030-01-01", "PASS"), (lambda p: p, "2024-06-01", "AS_OF_VIOLATION"), (lambda p: p.filter("asset = 'A'"), "2030-01-01", "RETURN_PANEL_EMPTY_OR_TOO_NARROW"),
    (lambda p: p.filter("obs_no < 9"), "2030-01-01", "INSUFFICIENT_HISTORY:9<315"), (lambda p: p.filter("not (obs_no = 3 and asset = 'B')"), "2030-01-01", "NON_FINITE_RETURN"),
    (lambda p: p.withColumn("ret", F.when(F.col("obs_no") == 4, float("nan")).otherwise(F.col("ret"))), "2030-01-01", "NON_FINITE_RETURN"),
    (lambda p: p.withColumn("ret", F.when(F.col("obs_no") == 4, 1.0).otherwise(F.col("ret"))), "2030-01-01", "IMPLAUSIBLE_DAILY_RETURN"),
    (lambda p: p.unionByName(p.filter("obs_no = 1")), "2030-01-01", "DUPLICATE_ASSET_COLUMNS")])
def test_panel_gate(panel, change, as_of, status):
    assert gates.panel_gate(change(panel), as_of).first().gate_status == status


def test_gate_closes(panel):
    with pytest.raises(gates.ResearchClosed):
        gates.require(gates.panel_gate(panel, "2024-06-01"))


def test_gate_closes_on_missing_panels_and_dates(spark, panel):
    empty = panel.limit(0)
    with pytest.raises(gates.ResearchClosed):
        gates.require(gates.panel_gate(empty, "2030-01-01"))
    got = {r.panel_id: r.gate_status for r in gates.panel_gate(empty, "2030-01-01", expected=["P", "Q"]).collect()}
    assert got == {k: "RETURN_PANEL_EMPTY_OR_TOO_NARROW" for k in "PQ"}
    holed = panel.withColumn("dt", F.when(F.col("obs_no") != 7, F.col("dt")))
    assert {r.gate_status for r in gates.panel_gate(holed, "2030-01-01").collect()} == {"INDEX_NOT_DATETIME"}


def test_execution_follows_the_panels_own_calendar(panel):
    """A second panel on the days between: each panel's next date is its own."""
    other = panel.withColumn("panel_id", F.lit("other")).withColumn("dt", F.date_add("dt", 1))
    got = backtest.execution(panel.withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), (2 * F.col("obs_no")).cast("int"))).unionByName(
        other.withColumn("dt", F.date_add(F.lit("2020-01-02").cast("date"), (2 * F.col("obs_no")).cast("int"))))).collect()
    assert len({r.panel_id for r in got}) == 2 and all(r.aligned for r in got)


def test_panels_stay_apart(spark, panel):
    """Two panels of other assets, one without a usable rule: each has its own rows in every table of evidence."""
    other = panel.filter("asset <> 'C'").withColumn("panel_id", F.lit("Q")).withColumn("ret", F.when((F.col("asset") == "A") & (F.col("obs_no") == 3), float("nan")).otherwise(F.col("ret")))
    both = panel.unionByName(other).cache()
    cov = risk.train_covariance(both)
    allocations = allocate.build("inverse_volatility", cov, None).cache()
    equal = both.join(both.select("panel_id", "asset").distinct().groupBy("panel_id").count(), "panel_id").select("panel_id", "asset", (1 / F.col("count")).alias("weight")).distinct()
    held = backtest.constrained(allocations, equal, equal, cov, ResearchPolicy()).cache()
    targets = backtest.latest_targets(held)
    assert {r.panel_id for r in targets.collect()} == {"P"} and targets.count() == 4
    shots = {r.panel_id: r for r in backtest.snapshot(both, targets, equal, equal).collect()}
    assert len(shots["P"].targets) == 4 and shots["Q"].targets is None and len(shots["Q"].benchmark) == 3
    trace = {(r.panel_id, r.split_id): r for r in backtest.filter_trace(allocations, both).collect()}
    assert {k: r.reason for k, r in trace.items()} == {(p, f"WF00{i}"): ("PASS" if p == "P" else "NOT_EVALUABLE") for p in "PQ" for i in (0, 1)}
    assert trace["Q", "WF000"].evidence_gap == "MISSING_VOLATILITY" and trace["P", "WF000"].source_ref != trace["Q", "WF000"].source_ref
    gone = backtest.rejected(backtest.filter_trace(allocations, both), ["inverse_volatility"], both).collect()
    assert sorted((r.panel_id, r.reason) for r in gone) == [("P", "NO_AUTO_PROMOTION"), ("Q", "NOT_EVALUABLE"), ("Q", "NOT_EVALUABLE"), ("Q", "NO_AUTO_PROMOTION")]
    rows, when = splits.walk_forward_rows(both, "test"), backtest.execution(both)
    evaluated = backtest.evaluation(held, rows, ResearchPolicy()).withColumn("differential_status", F.lit("PASS")).cache()
    told = {(r.panel_id, r.split_id): r for r in backtest.report(evaluated, when, rows, allocations).collect()}
    assert len(told) == 4 and told["Q", "WF000"].total_return is None and told["P", "WF000"].execution_time == DAYS[252] and told["P", "WF000"].test_end == DAYS[314]
    matrix = backtest.with_stability(backtest.challenge_matrix(evaluated, ["inverse_volatility"], both), backtest.stability(held))
    assert {r.panel_id: (r.n_splits, r.status, r.region) for r in matrix.collect()} == {"P": (2, "OK", "STABLE_REGION"), "Q": (0, "NOT_EVALUABLE", "NOT_EVALUABLE")}
    assert {r.panel_id for r in backtest.replay(evaluated, when, both).collect()} == {"P"}


def test_aligned_weights_are_the_panels_own(spark, panel):
    both = panel.unionByName(panel.withColumn("panel_id", F.lit("Q")))
    own = spark.createDataFrame([("P", "A", 1.0, 1), ("Q", "B", 0.5, 1), ("Q", "C", 0.5, 1)], "panel_id string, asset string, weight double, row_id int")
    got = {(r.panel_id, r.asset): r.weight for r in gates.align_weights(own, both).collect()}
    assert {k for k, w in got.items() if w > 0} == {("P", "A"), ("Q", "B"), ("Q", "C")} and len(got) == 8


def test_nan_volatility_is_not_evaluable(panel):
    spoilt = panel.withColumn("ret", F.when((F.col("asset") == "CASH") & (F.col("obs_no") == 3), float("nan")).otherwise(F.col("ret")))
    cov = risk.train_covariance(spoilt)
    for rule in ("inverse_volatility", "hierarchical_risk_parity"):
        got = allocate.build(rule, cov, None).collect()
        assert got and {r.status for r in got} == {"NOT_EVALUABLE"} and all(r.weight is None for r in got)


def test_caps_keep_assets_of_one_side(spark):
    previous = spark.createDataFrame([("P", "A", 0.5), ("P", "D", 0.5)], "panel_id string, asset string, weight double")
    got = {r.asset: r for r in backtest.cap_turnover(weights(spark, "x", A=0.5, B=0.3, C=0.2), previous, 0.25).collect()}
    assert set(got) == set("ABCD") and abs(got["A"].turnover_requested - 0.5) < 1e-12
    assert [round(got[k].weight, 9) for k in "ABCD"] == [0.5, 0.15, 0.1, 0.25]


def test_splits_are_disjoint_and_embargoed(panel):
    wf = splits.walk_forward_rows(panel, "train").withColumn("role", F.lit("train")).unionByName(splits.walk_forward_rows(panel, "test").withColumn("role", F.lit("test")))
    assert [(r.n_shared, r.train_first) for r in splits.disjoint(wf).collect()] == [(0, True), (0, True)]
    by = {(r.split_id, r.role): (r.first_obs, r.last_obs) for r in splits.membership(wf).collect()}
    assert by == {("WF000", "train"): (0, 251), ("WF000", "test"): (252, 314), ("WF001", "train"): (0, 314), ("WF001", "test"): (315, 377)}
    cp = splits.purged(panel, ResearchPolicy(min_train=100))
    rows = cp.select("split_id", "role", "obs_no").distinct().collect()
    assert len({r.split_id for r in rows}) == 15
    for s in {r.split_id for r in rows}:
        test = {r.obs_no for r in rows if r.split_id == s and r.role == "test"}
        train = {r.obs_no for r in rows if r.split_id == s and r.role == "train"}
        assert all(abs(a - b) > 5 for a in train for b in (min(test), max(test))) and not train & test
        assert train == {o for o in range(400) if all(abs(o - t) > 5 for t in test)}


def test_prefix_moments_agree_with_direct_ones(panel):
    fast = {(r.split_no, r.a, r.b): r.cov for r in risk.train_covariance(panel).collect()}
    slow = {(r.split_no, r.a, r.b): r.cov for r in risk.covariance(splits.walk_forward_rows(panel, "train")).collect()}
    assert fast.keys() == slow.keys() and max(abs(fast[k] - slow[k]) for k in fast) < 1e-12
    assert all(v == 0 for k, v in fast.items() if "CASH" in k)


def test_zero_volatility_is_floored_and_recorded(panel):
    got = allocate.build("inverse_volatility", risk.train_covariance(panel), None).collect()
    assert {r.message for r in got} == {"CASH"}
    assert abs(sum(r.weight for r in got if r.split_no == 0) - 1) < 1e-12


def test_unknown_rule():
    with pytest.raises(KeyError):
        allocate.build("nothing", None, None)


def test_hrp_sums_to_one_and_orders_leaves(panel):
    got = allocate.build("hierarchical_risk_parity", risk.train_covariance(panel), None).collect()
    for k in (0, 1):
        own = [r.weight for r in got if r.split_no == k]
        assert abs(sum(own) - 1) < 1e-9 and min(own) >= 0
    assert allocate.leaf_order([(a, b, d) for a, b, d in [("a", "b", 0.5), ("a", "c", 0.1), ("b", "c", 0.5)]] + [(x, x, 0.0) for x in "abc"]) in (["b", "a", "c"], ["a", "c", "b"])


def test_contributions_sum_to_cvar(panel):
    rows = splits.walk_forward_rows(panel, "train")
    w = allocate.build("equal_weight", risk.train_covariance(panel), None).select(*SPLIT, "asset", "weight")
    parts = {r.split_no: r.c for r in risk.tail_contribution(rows, w).groupBy("split_no").agg(F.sum("contribution").alias("c")).collect()}
    port = rows.join(w, [*SPLIT, "asset"]).groupBy(*SPLIT, "obs_no").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    whole = {r.split_no: r.cvar for r in risk.tail_mean(port, SPLIT, -F.col("r"), "cvar").collect()}
    assert all(abs(parts[k] - whole[k]) < 1e-12 for k in whole)


def test_turnover_cap_conserves(spark):
    bench = previous = spark.createDataFrame([("P", "A", 0.8), ("P", "B", 0.1), ("P", "C", 0.1)], "panel_id string, asset string, weight double")
    got = backtest.cap_turnover(weights(spark, "x", A=0.1, B=0.8, C=0.1), previous, 0.10).collect()
    assert abs(sum(r.weight for r in got) - 1) < 1e-12 and all(r.turnover <= 0.1 + 1e-9 and r.turnover_binding and abs(r.turnover_requested - 0.7) < 1e-12 for r in got)


@pytest.mark.parametrize(("w", "status"), [((0, 0), "ALL_CASH_OR_ZERO_WEIGHT_PROPOSAL"), ((-0.1, 1), "SHORT_WEIGHT_PROPOSED"), ((float("nan"), 1), "NON_FINITE_WEIGHT"), ((1, 3), "OK")])
def test_normalize(spark, w, status):
    df = spark.createDataFrame([("P", "A", float(w[0])), ("P", "B", float(w[1]))], "panel_id string, asset string, weight double")
    got = gates.normalize_long_only(df, ["panel_id"]).orderBy("asset").collect()
    assert {r.status for r in got} == {status} and (status != "OK" or [r.weight for r in got] == [0.25, 0.75])


def test_first_loss_is_no_drawdown_and_cost_falls_on_day_one(spark):
    df = spark.createDataFrame([("P", i, r, 0.1) for i, r in enumerate([-0.5, 0.1, -0.1])], "panel_id string, obs_no long, ret double, turnover double")
    got = risk.performance(df, ["panel_id"], 10.0).first()
    assert abs(got.max_drawdown + 0.1) < 1e-12 and abs(got.total_return - ((1 - 0.5001) * 1.1 * 0.9 - 1)) < 1e-12 and got.cost == 0.1 * 10 / 1e4


def test_differential_and_missing_day(spark, panel):
    held = weights(spark, "x", A=0.2, B=0.3, C=0.5)
    rows = splits.walk_forward_rows(panel, "test").filter("split_no = 0")
    one, two = backtest.portfolio_returns(held, rows), backtest.portfolio_returns_folded(held, rows)
    assert backtest.differential(one, two, 1e-12).first().status == "PASS"
    assert backtest.differential(one, two.filter("obs_no <> 260"), 1e-12).first().status == "FAIL"
