"""Quotes: one good quote and what spoils it, prices, parity, scenarios; and the scans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import pricing
from tallyweir.operators import quotes, scan
from tallyweir.schemas import QUOTE_FIELDS
from tallyweir.sources import files

AS_OF = datetime(2026, 1, 15)
iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S+00:00")
GOOD = {"source_event_id": "e", "observed_at": iso(AS_OF - timedelta(minutes=5)), "available_at": iso(AS_OF - timedelta(minutes=4)), "quote_time": iso(AS_OF - timedelta(minutes=5)), "expiry": iso(AS_OF + timedelta(days=90)),
        "source_url": "u", "underlying": "X", "option_type": "call", "exercise_style": "European", "pricing_model": "black_scholes_european", "currency": "HKD", "strike": "105", "bid": "5.90", "ask": "6.10", "volume": "50",
        "open_interest": "500", "contract_multiplier": "100", "underlying_price": "100", "risk_free_rate": "0.025", "dividend_yield": "0", "vendor_iv": None}


def check(spark, **change):
    row = GOOD | change
    raw = spark.createDataFrame([tuple(row[c] for c in QUOTE_FIELDS)], ", ".join(f"{c} string" for c in QUOTE_FIELDS)).withColumn("row_id", F.lit(0))
    return quotes.validated(raw, "2026-01-15 00:00:00").first()


@pytest.mark.parametrize(("change", "status", "reasons"), [
    ({}, "PASS", ""), ({"quote_time": iso(AS_OF + timedelta(minutes=1))}, "REJECT", "FUTURE_EVIDENCE"), ({"bid": "7", "ask": "6"}, "REJECT", "CROSSED_MARKET"),
    ({"observed_at": "2026-01-14T23:55:00"}, "REJECT", "OBSERVED_AT_MUST_BE_TIMEZONE_AWARE"), ({"expiry": "soon+00:00"}, "REJECT", "EXPIRY_UNPARSEABLE"), ({"currency": "USD", "volume": "1"}, "REJECT", "CURRENCY_NOT_HKD;VOLUME_THIN"),
    ({"volume": "9"}, "THIN", "VOLUME_THIN"), ({"strike": "x"}, "REJECT", "NON_NUMERIC_STRIKE"), ({"bid": ""}, "REJECT", "INVALID_BID_ASK"), ({"volume": ""}, "PASS", ""), ({"strike": ""}, "REJECT", "NON_FINITE_STRIKE"),
    ({"pricing_model": "quantlib_explicit", "exercise_style": "american"}, "NOT_EVALUABLE", "QUANTLIB_DEPENDENCY_MISSING"), ({"bid": "99", "ask": "105"}, "REJECT", "MID_OUTSIDE_NO_ARBITRAGE_BOUNDS"),
    ({"bid": "0", "ask": "6.1"}, "THIN", "SPREAD_WIDE;OPTION_PRICE_NON_POSITIVE;IMPLIED_VOL_NO_ROOT")])
def test_quote(spark, change, status, reasons):
    got = check(spark, **change)
    want = reasons.split(";") if reasons else []
    assert got.quality_status == status and set(got.reasons.split(";") if got.reasons else []) <= set(want) and (not want or got.reasons.split(";")[0] == want[0])
    assert (got.evidence_only, got.actionable, got.auto_order) == (True, False, False)


def test_maturity_counts_from_as_of(spark):
    old = iso(AS_OF - timedelta(days=10))
    got = check(spark, quote_time=old, observed_at=old, available_at=old)
    assert got.dte == 90 and abs(got.maturity - 90 / 365) < 1e-12 and abs(got.parity_maturity - 100 / 365) < 1e-12


def test_residual_is_relative_to_mid(spark):
    df = spark.createDataFrame([(10.3, 10.0), (9.7, 10.0), (1.0, 0.0)], "t double, m double")
    got = [r[0] for r in df.select(quotes.relative_residual(F.col("t"), F.col("m"))).collect()]
    assert abs(got[0] - 0.03) < 1e-12 and abs(got[1] + 0.03) < 1e-12 and got[2] is None


def test_implied_volatility_reprices_and_both_paths_agree(spark):
    df = spark.createDataFrame([(k % 2 == 0, 100.0, 80.0 + k, 0.1 + k / 40, 0.02, 0.01, 0.05 + k * 0.03) for k in range(40)], "c boolean, s double, k double, t double, r double, q double, v double")
    price = pricing.black_scholes(*[F.col(x) for x in "cskt"], F.col("r"), F.col("q"), F.col("v"))
    both = df.withColumn("p", price).withColumn("iv", pricing.implied_vols(*[F.col(x) for x in "csktrq"], "p", "p", "p")).withColumn("f", pricing.implied_vol_folded(*[F.col(x) for x in "csktrq"], F.col("p")))
    back = pricing.black_scholes(*[F.col(x) for x in "csktrq"], F.col("iv.mid"))
    rows = both.withColumn("b", back).collect()
    assert all(abs(r.b - r.p) < 1e-9 and abs(r.f - r.iv.mid) < 1e-9 for r in rows if r.iv.mid is not None) and sum(r.iv.mid is not None for r in rows) > 35


def test_sale_floor_cannot_be_broken(spark):
    states = spark.createDataFrame([("X", 80.0, 90.0, 0, 1000, 1.25, 100), ("Y", 100.0, 90.0, 0, 1000, 1.25, 100), ("Z", 80.0, 90.0, 2, 1050, 1.25, 100), ("B", 0.0, 90.0, 0, 1, 1.0, 100)], "state_id string, price double, protection_floor double, hard_risk_count int, base_sale_units int, risk_overlay_multiplier double, lot_size int")
    quality = spark.createDataFrame([("X", "PASS"), ("Y", "THIN_OR_REJECT")], "underlying string, quality string")
    got = {r.state_id: r for r in quotes.sale_rule(states, quality).collect()}
    assert (got["X"].sale_units, got["Y"].sale_units, got["Z"].sale_units, got["B"].sale_units) == (0, 1200, 1000, None)
    assert got["X"].covered_call_status == "HUMAN_REVIEW_ONLY" and got["Y"].covered_call_status == "DISABLED" and got["B"].invariants == "FAIL"


def test_covered_calls_are_never_actionable(spark):
    q = spark.createDataFrame([("X", "CALL", "PASS", 105.0, 0.03, 90, 1, 6.0, 100.0)], "underlying string, option_type string, quality_status string, strike double, spread_to_mid double, dte int, row_id long, mid double, contract_multiplier double")
    a = spark.createDataFrame([("X", 0, 90.0, 0), ("X", 1, 110.0, 1000), ("Y", 0, 90.0, 100)], "underlying string, anchor_no int, anchor_price double, reference_units int")
    got = {(r.underlying, r.anchor_no, r.fee): r for r in quotes.covered_calls(q, a, [5.0, None]).collect()}
    assert not any(r.actionable for r in got.values()) and got["X", 0, 5.0].contracts == 0 and got["X", 0, 5.0].effective_exit is None
    assert got["X", 1, 5.0].premium == 5950.0 and got["X", 1, 5.0].effective_exit == 110.95 and (got["X", 1, 5.0].status, got["X", 1, None].status, got["X", 1, None].reason, got["Y", 0, 5.0].reason) == ("COUNTERFACTUAL_ONLY", "NOT_EVALUABLE", "FEE_UNKNOWN", "NO_VALID_CALL_QUOTE")


def test_parity_of_repriced_quotes_is_zero(spark):
    rows = [("X", AS_OF, 100.0, k, i, "PASS", "EUROPEAN", 0.5, 100.0, 0.02, 0.01) for i, k in enumerate(("CALL", "PUT", "CALL"))]
    df = spark.createDataFrame(rows, "underlying string, expiry timestamp, strike double, option_type string, row_id long, quality_status string, exercise_style string, parity_maturity double, underlying_price double, risk_free_rate double, dividend_yield double")
    df = df.withColumn("mid", pricing.black_scholes(F.col("option_type") == "CALL", F.col("underlying_price"), F.col("strike"), F.col("parity_maturity"), F.col("risk_free_rate"), F.col("dividend_yield"), F.lit(0.3)))
    got = quotes.parity(df).collect()
    assert len(got) == 1 and got[0].call_row == 0 and abs(got[0].residual) < 1e-10
    assert quotes.parity(df.limit(0)).count() == 0


def test_policy_defaults_and_reasons(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None, None, None, None, [(3.0, 4)]), ("b", None, 2.0, None, None, None, None, [])], files.POLICY)
    states, anchors, reasons = files.states_and_anchors(df)
    assert states.first().lot_size == 100 and anchors.count() == 1 and {r.reason for r in reasons.collect()} == {"MISSING_PRICE", "MISSING_ANCHORS"}


def test_scan_rules(spark):
    secret = ["-----BEGIN " + "PRIVATE KEY-----", "gh" + "p_" + "a" * 24, "AKIA" + "B" * 16, "api_key" + " = '" + "x" * 10 + "'", "me@" + "mail.org", "1380" + "0138000", "91380" + "0138000", "clean"]
    got = scan.scan_text(spark.createDataFrame([("s", str(i), t) for i, t in enumerate(secret)], "source string, id string, text string")).collect()
    assert sorted((int(r.id), r.rule) for r in got) == list(enumerate(scan.RULES))
    paths = {r.id: (r.blocked, r.fragments) for r in scan.scan_paths(spark.createDataFrame([(1, "a/x.PDF"), (2, "My_Holdings/rsu.txt"), (3, "a.b/c")], "id int, path string")).collect()}
    assert paths == {1: (True, ""), 2: (False, "holdings;rsu"), 3: (False, "")}


def test_written_tables_are_not_overwritten(spark, tmp_path):
    files.write_once(spark.range(3), f"{tmp_path}/t")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.write_once(spark.range(3), f"{tmp_path}/t")


def test_stream_gives_the_batch_result(spark, tmp_path):
    from tallyweir.streaming.quotes import validated_stream

    raw = spark.createDataFrame([tuple(GOOD[c] for c in QUOTE_FIELDS)], ", ".join(f"{c} string" for c in QUOTE_FIELDS)).withColumn("row_id", F.lit(0))
    raw.write.parquet(f"{tmp_path}/in")
    stream = validated_stream(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), "2026-01-15 00:00:00")
    q = stream.select("row_id", "quality_status").writeStream.format("memory").queryName("quote_stream").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select quality_status from quote_stream").first()[0] == "PASS"
