"""Gates, the as-of join, nearest strikes, linkage, readers and written evidence on hand-made frames."""

import json
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import allocate, backtest, evidence, gates, quotes, scan
from tallyweir.plans.research import RULES, Research
from tallyweir.schemas import QUOTE_FIELDS, ResearchPolicy
from tallyweir.sources import files

PANEL = "panel_id string, obs_no long, dt date, asset string, ret double"
SMALL = ResearchPolicy(min_train=40, test=10, step=20, embargo=1)


def rows(panel_id, days, assets="ABC", seed=1, start=date(2024, 1, 1), every=1):
    rng = random.Random(seed)
    return [(panel_id, i, start + timedelta(days=i * every), a, rng.gauss(0.0005, 0.01)) for i in range(days) for a in assets]


def equal(panel):
    own = panel.select("panel_id", "asset").distinct()
    return own.join(own.groupBy("panel_id").count(), "panel_id").select("panel_id", "asset", (1 / F.col("count")).alias("weight"))


@pytest.fixture(scope="module")
def panels(spark):
    """Sound panels of unequal calendars and assets, a short one, one with a hole and one whose dates run backwards."""
    back = [(p, i, date(2025, 1, 1) - timedelta(days=i), a, r) for p, i, _, a, r in rows("back", 80)]
    hole = [r for r in rows("hole", 80) if r[1:4:2] != (5, "B")]
    return spark.createDataFrame(rows("one", 80) + rows("two", 120, "ABCD", 2, date(2023, 6, 1), 2) + rows("short", 30) + back + hole, PANEL).cache()


def test_panels_that_fail_are_set_aside(panels):
    r = Research(panels, equal(panels), equal(panels), "2030-01-01", ["equal_weight", "inverse_volatility"], SMALL, close=False)
    assert {x.panel_id: x.gate_status for x in r.gate.collect()} == {"one": "PASS", "two": "PASS", "short": "INSUFFICIENT_HISTORY:30<50", "back": "RETURN_INDEX_NOT_STRICTLY_INCREASING", "hole": "NON_FINITE_RETURN"}
    trace = r.trace().collect()
    assert {(x.panel_id, x.reason) for x in trace if x.stage == "PANEL_GATE"} == {("short", "INSUFFICIENT_HISTORY:30<50"), ("back", "RETURN_INDEX_NOT_STRICTLY_INCREASING"), ("hole", "NON_FINITE_RETURN")}
    assert {x.panel_id for x in trace if x.stage == "CHALLENGER_BUILD"} == {"one", "two"} and all(x.source_ref is not None for x in trace)
    assert {x.panel_id: x.n_splits for x in r.matrix().filter("challenger = 'equal_weight'").collect()} == {"one": 2, "two": 4, "short": 0, "back": 0, "hole": 0}
    r.require_sound()
    with pytest.raises(gates.ResearchClosed):
        Research(panels, equal(panels), equal(panels), "2030-01-01", RULES, SMALL)
    with pytest.raises(gates.ResearchClosed, match="PARAMETER_BUDGET_EXCEEDED"):
        Research(panels, equal(panels), equal(panels), "2030-01-01", RULES, ResearchPolicy(parameter_budget=5))


def test_a_run_writes_its_evidence_once(spark, panels, tmp_path):
    panel = panels.filter("panel_id = 'one'")
    r = Research(panel, equal(panel), equal(panel), "2030-01-01", RULES, SMALL)
    told = {x.name: x for x in r.write(f"file://{tmp_path}/run").collect()}
    assert {x.status for x in told.values()} == {"OK"} and len(told) == 14 and all(x.bytes > 0 and x.files > 0 for x in told.values())
    back = spark.read.parquet(f"file://{tmp_path}/run/walk_forward_results")
    assert back.count() == told["walk_forward_results"].n_rows == 12 and {x.challenger for x in back.collect()} == set(RULES)
    lines = [json.loads(x) for p in Path(f"{tmp_path}/run/decision_snapshot.json").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["status"] == "ACTIVE_SHADOW_LOCKED" and not lines[0]["order_created"] and lines[0]["policy_hash"] == evidence.policy_hash(SMALL)
    first = max(p.stat().st_mtime for p in Path(f"{tmp_path}/run/pre_registration.json").glob("part-*"))
    assert first <= min(p.stat().st_mtime for p in Path(f"{tmp_path}/run/walk_forward_results").glob("part-*"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        r.write(f"file://{tmp_path}/run")


def test_written_tables_are_told_as_they_lie(spark, tmp_path):
    told = {x.name: x for x in evidence.written({"some": spark.range(7), "none": spark.range(0)}, f"file://{tmp_path}/w").collect()}
    assert told["some"].n_rows == 7 and told["some"].bytes == sum(p.stat().st_size for p in Path(f"{tmp_path}/w/some").glob("part-*")) and told["none"].status == "EMPTY_OUTPUT"
    assert told["some"].content_hash == spark.range(7).agg(evidence.content_hash(spark.range(7))).first()[0]
    with pytest.raises(gates.ResearchClosed, match="EMPTY_OUTPUT:none"):
        evidence.require_outputs(evidence.written({"none": spark.range(0)}, f"file://{tmp_path}/v"))


def test_caps_are_measured_again(spark, panels):
    panel = panels.filter("panel_id = 'one'")
    r = Research(panel, equal(panel), equal(panel), "2030-01-01", ["inverse_volatility"], SMALL)
    assert {x.status for x in backtest.conserved(r.held(), r.bench, r.cov, SMALL).collect()} == {"OK"}
    moved = r.held().withColumn("weight", F.when(F.col("asset") == "A", F.col("weight") + 0.3).when(F.col("asset") == "B", F.col("weight") - 0.3).otherwise(F.col("weight")))
    assert {x.status for x in backtest.conserved(moved, r.bench, r.cov, SMALL).collect()} == {"TURNOVER_CAP_NOT_CONSERVED"}
    assert {x.status for x in backtest.conserved(r.held().withColumn("te_before", F.lit(0.0)).withColumn("raw", F.col("raw") * F.when(F.col("asset") == "A", 9.0).otherwise(1.0)), r.bench, r.cov, SMALL).collect()} == {"TRACKING_ERROR_CAP_NOT_CONSERVED"}


def test_drift_needs_numbers(spark):
    w = spark.createDataFrame([(p, a, x) for p in "PQRS" for a, x in (("A", 0.5), ("B", float("nan") if p == "R" else 0.5))], "panel_id string, asset string, weight double")
    ret = spark.createDataFrame([("P", "A", 0.1), ("P", "B", -0.1), ("Q", "A", float("nan")), ("Q", "B", 0.1), ("R", "A", 0.1), ("R", "B", 0.1), ("S", "A", -1.0), ("S", "B", -1.0)], "panel_id string, asset string, ret double")
    got = {(r.panel_id, r.asset): (r.weight, r.status) for r in gates.drift_weights(w, ret).collect()}
    assert {k: v[1] for k, v in got.items()} == {("P", "A"): "OK", ("P", "B"): "OK", **{(p, a): s for p, s in (("Q", "MISSING_EXECUTION_RETURN"), ("R", "NON_FINITE_WEIGHT"), ("S", "DRIFTED_PORTFOLIO_NON_POSITIVE")) for a in "AB"}}
    assert all(v[0] is None for k, v in got.items() if k[0] != "P") and abs(got["P", "A"][0] - 0.55) < 1e-12


def test_next_time_of_several_calendars(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(5_000))
    calendar = [(k, at()) for k in ("x", "y", None) for _ in range(200)] + [("early", start)]
    asked = [(k, at()) for k in ("x", "y", "early", "none", None) for _ in range(150)] + calendar[:50] + [("x", None)]
    got = gates.next_tradable(spark.createDataFrame(asked, "k string, dt timestamp"), spark.createDataFrame(calendar, "k string, dt timestamp"), ["k"]).collect()
    want = [(k, d, min((c for q, c in calendar if q == k and d is not None and c > d), default=None)) for k, d in asked]
    assert sorted(((r.k, r.dt, r.next_dt) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.status == ("OK" if r.next_dt else "NO_NEXT_TRADABLE_TIME") for r in got)


def test_nearest_strike_by_two_sides(spark):
    rng = random.Random(4)
    calls = [(u, rng.choice(["CALL", "CALL", "PUT"]), rng.choice(["PASS", "THIN", "REJECT"]), float(rng.randrange(80, 120)), rng.choice([0.01, 0.02, None]), rng.randrange(1, 4), i, 5.0, 100.0) for i, u in enumerate(rng.choices("XYZ", k=300))]
    anchors = [(u, k, float(rng.randrange(70, 130)) + rng.choice([0, 0.5]), 1000) for u in "XYW" for k in range(30)]
    q = spark.createDataFrame(calls, "underlying string, option_type string, quality_status string, strike double, spread_to_mid double, dte int, row_id long, mid double, contract_multiplier double")
    got = {(r.underlying, r.anchor_no): r.call_row for r in quotes.covered_calls(q, spark.createDataFrame(anchors, "underlying string, anchor_no int, anchor_price double, reference_units int"), [5.0]).collect()}
    for u, k, price, _ in anchors:
        own = [c for c in calls if c[0] == u and c[1] == "CALL" and c[2] != "REJECT"]
        best = min(own, key=lambda c: (abs(c[3] - price), float("inf") if c[4] is None else c[4], c[5], c[6]), default=None)
        assert got[u, k] == (best and best[6])


def test_negative_overlays_sell_nothing(spark):
    states = spark.createDataFrame([("X", 100.0, 90.0, 0, 1000, -0.5, 100)], "state_id string, price double, protection_floor double, hard_risk_count int, base_sale_units int, risk_overlay_multiplier double, lot_size int")
    got = quotes.sale_rule(states, spark.createDataFrame([("X", "PASS")], "underlying string, quality string")).first()
    assert got.sale_units == 0 and got.invariants == "PASS"


def chain_row(**change):
    base = dict(source_event_id="E", observed_at="2026-01-15T07:55:00+08:00", available_at="2026-01-15T07:56:00+08:00", quote_time="2026-01-15T07:55:00+08:00", expiry="2026-04-15T08:00:00+08:00", source_url="u", underlying="X", option_type="CALL", exercise_style="EUROPEAN",
                pricing_model="BLACK_SCHOLES_EUROPEAN", currency="HKD", strike="105", bid="5.9", ask="6.1", volume="100", open_interest="1000", contract_multiplier="100", underlying_price="100", risk_free_rate="0.025", dividend_yield="0", vendor_iv="")
    return base | change


@pytest.mark.parametrize(("change", "status", "reason", "found"), [
    ({}, "PASS", "", (True, True, True)), ({"bid": "0", "ask": "12"}, "THIN", "SPREAD_WIDE;OPTION_PRICE_NON_POSITIVE", (False, False, False)),
    ({"strike": "0", "bid": "99", "ask": "101"}, "THIN", "BLACK_SCHOLES_INPUT_NON_POSITIVE", (False, False, False)),
    ({"strike": "80", "bid": "20.2", "ask": "21.2"}, "THIN", "IMPLIED_VOL_NO_ROOT", (False, False, False))])
def test_the_first_price_without_a_volatility_ends_the_row(spark, change, status, reason, found):
    raw = spark.createDataFrame([tuple(chain_row(**change)[c] for c in QUOTE_FIELDS)], ", ".join(f"{c} string" for c in QUOTE_FIELDS)).withColumn("row_id", F.lit(0))
    got = quotes.validated(raw, "2026-01-15 00:00:00").first()
    assert (got.quality_status, got.reasons) == (status, reason) and tuple(x is not None for x in (got.iv.bid, got.iv.mid, got.iv.ask)) == found and (got.theoretical is not None) == all(found)


@pytest.mark.parametrize("side", [1, 3, 256])
def test_few_pairs_give_the_leaves_of_all(spark, side):
    """Distances with many ties."""
    rng = random.Random(8)
    names = [f"a{i:02d}" for i in range(23)]
    dist = {}
    for k in range(2):
        for i, a in enumerate(names):
            for b in names[i:]:
                dist[k, a, b] = dist[k, b, a] = 0.0 if a == b else rng.randrange(1, 5) / 8
    df = spark.createDataFrame([("P", k, f"WF00{k}", a, b, d) for (k, a, b), d in dist.items()], "panel_id string, split_no int, split_id string, a string, b string, dist double")
    kept = allocate.merging_pairs(df, side).collect()
    for k in range(2):
        few, every = [(r.a, r.b, r.dist) for r in kept if r.split_no == k], [(a, b, d) for (q, a, b), d in dist.items() if q == k]
        assert allocate.leaf_order(few) == allocate.leaf_order(every) and (side < 256 or len(few) == 23 + 22)


# --- readers --------------------------------------------------------------------------------------------------------


def test_read_panel_numbers_dates(spark, tmp_path):
    Path(f"{tmp_path}/a.csv").write_text("date,A,B\n2024-01-03,0.1,0.2\n2024-01-02,0.3,\n")
    Path(f"{tmp_path}/b.csv").write_text("day,A\n2024-01-03,0.1\n")
    got = sorted((r.obs_no, str(r.dt), r.asset, r.ret) for r in files.read_panel(spark, f"{tmp_path}/a.csv", "P").collect())
    assert got == [(0, "2024-01-02", "A", 0.3), (0, "2024-01-02", "B", None), (1, "2024-01-03", "A", 0.1), (1, "2024-01-03", "B", 0.2)]
    with pytest.raises(ValueError, match="MISSING_COLUMNS:date"):
        files.read_panel(spark, f"{tmp_path}/b.csv", "P")


def test_read_chain_and_weights_keep_the_order_of_files(spark, tmp_path):
    head = ",".join(QUOTE_FIELDS)
    Path(f"{tmp_path}/c").mkdir()
    for f in range(3):
        Path(f"{tmp_path}/c/{f}.csv").write_text(head + "\n" + "".join(",".join(chain_row(source_event_id=f"E{f}{i}")[c] for c in QUOTE_FIELDS) + "\n" for i in range(4)))
    got = sorted((r.row_id, r.source_event_id) for r in files.read_chain(spark, f"{tmp_path}/c").collect())
    assert got == [(4 * f + i, f"E{f}{i}") for f in range(3) for i in range(4)]
    Path(f"{tmp_path}/d.csv").write_text(head.replace(",vendor_iv", "") + "\n")
    with pytest.raises(ValueError, match="MISSING_COLUMNS:vendor_iv"):
        files.read_chain(spark, f"{tmp_path}/d.csv")
    Path(f"{tmp_path}/w.csv").write_text("asset,weight\nA,0.5\nB,0.5\nA,1.5\nC,nan\n")
    own = files.read_weights(spark, f"{tmp_path}/w.csv")
    aligned = gates.align_weights(own, spark.createDataFrame([("P", a) for a in "ABCD"], "panel_id string, asset string"))
    assert {r.asset: r.weight for r in aligned.collect()} == {"A": 0.75, "B": 0.25, "C": 0.0, "D": 0.0}
    with pytest.raises(ValueError, match="WEIGHT_FILE_REQUIRES_ASSET_WEIGHT"):
        files.read_weights(spark, f"{tmp_path}/c/0.csv")


def test_read_policies_and_files(spark, tmp_path):
    Path(f"{tmp_path}/p.json").write_text(json.dumps({"state_id": "s", "price": 1.0, "protection_floor": 2.0, "anchors": [{"price": 3.0, "reference_units": 4}]}, indent=2))
    states, anchors, reasons = files.states_and_anchors(files.read_policies(spark, f"{tmp_path}/p.json"))
    assert states.first().base_sale_units == 0 and anchors.first().reference_units == 4 and reasons.count() == 0
    Path(f"{tmp_path}/t").mkdir()
    Path(f"{tmp_path}/t/a.txt").write_text("mail me@" + "mail.org")
    Path(f"{tmp_path}/t/b.bin").write_bytes(b"\xff\xfe")
    Path(f"{tmp_path}/t/c.pdf").write_text("x")
    read = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, f"{tmp_path}/t").collect()}
    assert read == {"a.txt": "mail me@" + "mail.org", "b.bin": None, "c.pdf": "x"}
    found = scan.scan_text(files.read_files(spark, f"{tmp_path}/t").select(F.lit("f").alias("source"), F.col("path").alias("id"), "text"))
    assert [r.id.rsplit("/", 1)[1] for r in found.collect()] == ["a.txt"]
    told = {(r.path.rsplit("/", 1)[1], r.violation) for r in scan.scan_files(files.read_files(spark, f"{tmp_path}/t")).collect()}
    assert {("c.pdf", "blocked extension"), ("b.bin", "not UTF-8")} <= told and {p for p, _ in told} == {"a.txt", "b.bin", "c.pdf"}
    hits = files.read_files(spark, f"{tmp_path}/t").select("path").limit(2)
    assert scan.verdict(hits).first().verdict == "FAIL" and scan.verdict(hits.limit(0)).first().verdict == "PASS"
