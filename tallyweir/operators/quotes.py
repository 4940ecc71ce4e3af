"""Option quotes: parsing, ordered reason codes, classification, parity. One projection chain, so it also runs on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pricing import add_implied_vols, black_scholes
from ..schemas import NUMERIC_FIELDS, TIME_FIELDS, QualityPolicy

OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def _reason(test: Column, code: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(code))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def typed(raw: DataFrame, as_of: str) -> DataFrame:
    """Raw strings to values, with time_error: of the first time that fails, or of the visibility rules. Field by field in order.

    maturity is counted from as_of and serves bounds, volatilities and days to expiry; parity_maturity from the quote's own time.
    """
    out = raw.withColumn("as_of", F.lit(as_of).cast("timestamp"))
    first = None
    for c in TIME_FIELDS:
        own = F.when(~F.coalesce(F.col(c), F.lit("")).rlike(OFFSET), F.lit(f"{c.upper()}_MUST_BE_TIMEZONE_AWARE")).when(F.try_to_timestamp(c).isNull(), F.lit(f"{c.upper()}_UNPARSEABLE"))
        first = own if first is None else F.coalesce(first, own)
    out = out.withColumn("time_format_error", first)
    for c in TIME_FIELDS:
        out = out.withColumn(c, F.when(F.col("time_format_error").isNull(), F.try_to_timestamp(c)))
    for c in NUMERIC_FIELDS:
        blank = F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
        out = out.withColumn(f"bad_{c}", ~blank & F.col(c).try_cast("double").isNull()).withColumn(c, F.when(blank, float("nan")).otherwise(F.col(c).try_cast("double")))
    for c in ("option_type", "exercise_style", "currency", "pricing_model"):
        out = out.withColumn(c, F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))))
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 6e7
    years = lambda since: F.greatest((F.unix_micros("expiry") - F.unix_micros(since)) / 1e6 / (365 * 86400), F.lit(1 / 3650))
    out = out.withColumn("quote_age", minutes(F.col("as_of"), F.col("quote_time"))).withColumn("source_age", minutes(F.col("as_of"), F.col("available_at")))
    out = out.withColumn("maturity", years("as_of")).withColumn("parity_maturity", years("quote_time")).withColumn("dte", F.ceil(365 * F.col("maturity")).cast("int"))
    out = out.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return out.withColumn("spread_to_mid", F.when(_finite(F.col("mid")) & (F.col("mid") > 0), (F.col("ask") - F.col("bid")) / F.col("mid")))


def _bounds(q: DataFrame) -> tuple[Column, Column]:
    s, k, t = F.col("underlying_price"), F.col("strike"), F.col("maturity")
    spot, strike = s * F.exp(-F.col("dividend_yield") * t), k * F.exp(-F.col("risk_free_rate") * t)
    call, european, zero = F.col("option_type") == "CALL", F.col("exercise_style") == "EUROPEAN", F.lit(0.0)
    low = F.when(european & call, F.greatest(zero, spot - strike)).when(european, F.greatest(zero, strike - spot)).when(call, F.greatest(zero, s - k)).otherwise(F.greatest(zero, k - s))
    return low, F.when(european & call, spot).when(european, strike).when(call, s).otherwise(k)


def early_errors() -> list[Column]:
    """Errors before the price model, in check order."""
    bid, ask = F.col("bid"), F.col("ask")
    market = [_reason(~_finite(bid) | ~_finite(ask) | (bid < 0) | (ask <= 0), "INVALID_BID_ASK"), _reason(_finite(bid) & _finite(ask) & (bid > ask), "CROSSED_MARKET")]
    seen = F.greatest("observed_at", "available_at", "quote_time") > F.col("as_of")
    return [F.col("time_format_error"), _reason(seen, "FUTURE_EVIDENCE"), _reason(F.col("available_at") < F.col("observed_at"), "AVAILABLE_BEFORE_OBSERVED"),
            _reason(~F.col("option_type").isin("CALL", "PUT"), "INVALID_OPTION_TYPE"), _reason(~F.col("exercise_style").isin("EUROPEAN", "AMERICAN"), "INVALID_EXERCISE_STYLE"), _reason(F.col("currency") != "HKD", "CURRENCY_NOT_HKD"),
            *[_reason(F.col(f"bad_{c}"), f"NON_NUMERIC_{c.upper()}") for c in NUMERIC_FIELDS],
            *[_reason(~F.col(f"bad_{c}") & ~_finite(F.col(c)), f"NON_FINITE_{c.upper()}") for c in ("strike", "underlying_price", "risk_free_rate", "dividend_yield")], *market]


def early_warnings(p: QualityPolicy) -> list[Column]:
    low = lambda c, v: F.when(_finite(F.col(c)), F.col(c) < v)
    return [_reason(F.col("quote_age") > p.quote_minutes, "QUOTE_STALE"), _reason(F.col("source_age") > p.source_minutes, "SOURCE_STALE"), _reason(F.col("spread_to_mid") > p.spread, "SPREAD_WIDE"),
            _reason(low("open_interest", p.open_interest), "OPEN_INTEREST_THIN"), _reason(low("volume", p.volume), "VOLUME_THIN")]


def checked(quotes: DataFrame, p: QualityPolicy = QualityPolicy()) -> DataFrame:
    """typed quotes with errors, warnings, lower and upper bound, and model: which step prices the row, or why none does."""
    low, high = _bounds(quotes)
    out = quotes.withColumn("errors", F.array_compact(F.array(*early_errors()))).withColumn("warnings", F.array_compact(F.array(*early_warnings(p))))
    sound = F.size("errors") == 0
    out = out.withColumn("lower_bound", F.when(sound, low)).withColumn("upper_bound", F.when(sound, high))
    outside = F.coalesce((F.col("mid") < F.col("lower_bound") - 1e-9) | (F.col("mid") > F.col("upper_bound") + 1e-9), F.lit(False))
    out = out.withColumn("errors", F.when(sound & outside, F.array(F.lit("MID_OUTSIDE_NO_ARBITRAGE_BOUNDS"))).otherwise(F.col("errors")))
    model = (F.when(F.size("errors") > 0, "NONE").when((F.col("exercise_style") == "EUROPEAN") & (F.col("pricing_model") == "BLACK_SCHOLES_EUROPEAN"), "BLACK_SCHOLES")
             .when(F.col("pricing_model") == "QUANTLIB_EXPLICIT", "QUANTLIB_DEPENDENCY_MISSING").otherwise("UNSUPPORTED_EXPLICIT_PRICING_MODEL"))
    return out.withColumn("model", model)


def relative_residual(theoretical: Column, mid: Column) -> Column:
    """How far the model's price is from the mid, as a share of the mid; null at a mid of 0."""
    return F.when(mid != 0, (theoretical - mid) / mid)


def validated(raw: DataFrame, as_of: str, p: QualityPolicy = QualityPolicy()) -> DataFrame:
    """All checks: values, iv, theoretical, residual, quality_status, reasons and three constant flags."""
    q = add_implied_vols(checked(typed(raw, as_of), p), F.col("model") == "BLACK_SCHOLES")
    priced = F.col("model") == "BLACK_SCHOLES"
    # the first price without a volatility ends the row: later ones stay null
    iv = {"bid": F.col("iv.bid"), "mid": F.when(F.col("iv.bid").isNotNull(), F.col("iv.mid")), "ask": F.when(F.col("iv.bid").isNotNull() & F.col("iv.mid").isNotNull(), F.col("iv.ask"))}
    q = q.withColumn("iv", F.struct(*[v.alias(k) for k, v in iv.items()]))
    theo = black_scholes(F.col("option_type") == "CALL", *[F.col(c) for c in ("underlying_price", "strike", "maturity", "risk_free_rate", "dividend_yield")], F.col("iv.mid"))
    q = q.withColumn("theoretical", F.when(priced & F.col("iv.ask").isNotNull(), theo)).withColumn("model_residual", relative_residual(F.col("theoretical"), F.col("mid")))
    nonpos = priced & (F.least("bid", "mid", "ask") <= 0)
    inputs = priced & ~nonpos & (F.least("underlying_price", "strike") <= 0)
    missing = priced & ~nonpos & ~inputs & F.col("iv.ask").isNull()
    band = priced & F.col("iv.ask").isNotNull() & ~((F.col("iv.bid") <= F.col("iv.mid")) & (F.col("iv.mid") <= F.col("iv.ask")))
    unpriced = F.col("model").isin("QUANTLIB_DEPENDENCY_MISSING", "UNSUPPORTED_EXPLICIT_PRICING_MODEL")
    errors = F.array_compact(F.concat("errors", F.array(_reason(band, "IV_BAND_NON_MONOTONIC"))))
    warnings = F.array_compact(F.concat("warnings", F.array(F.when(unpriced, F.col("model")), _reason(nonpos, "OPTION_PRICE_NON_POSITIVE"), _reason(inputs, "BLACK_SCHOLES_INPUT_NON_POSITIVE"), _reason(missing, "IMPLIED_VOL_NO_ROOT"), _reason(F.abs("model_residual") > p.residual, "MODEL_RESIDUAL_HIGH"))))
    q = q.withColumn("errors", errors).withColumn("warnings", warnings)
    status = F.when(F.size("errors") > 0, "REJECT").when(unpriced, "NOT_EVALUABLE").when(F.size("warnings") > 0, "THIN").otherwise("PASS")
    q = q.withColumn("quality_status", status).withColumn("reasons", F.concat_ws(";", F.concat("errors", "warnings")))
    return q.withColumns({c: F.lit(v) for c, v in (("evidence_only", True), ("actionable", False), ("auto_order", False))}).drop(*[f"bad_{c}" for c in NUMERIC_FIELDS])


def parity(quotes: DataFrame) -> DataFrame:
    """Call-put pairs by (underlying, expiry, strike), null keys included, the first of each side by row_id: residual and status."""
    def side(kind: str, p: str) -> DataFrame:
        own = quotes.filter(F.col("option_type") == kind).groupBy("underlying", "expiry", "strike")
        cols = ("row_id", "mid", "quality_status", "exercise_style", "parity_maturity", "underlying_price", "risk_free_rate", "dividend_yield")
        return own.agg(F.min_by(F.struct(*cols), "row_id").alias(p))

    c, p = side("CALL", "c"), side("PUT", "p").withColumnsRenamed({k: f"p_{k}" for k in ("underlying", "expiry", "strike")})
    both = c.join(p, c["underlying"].eqNullSafe(p["p_underlying"]) & c["expiry"].eqNullSafe(p["p_expiry"]) & c["strike"].eqNullSafe(p["p_strike"]))
    usable = (F.col("c.exercise_style") == "EUROPEAN") & F.col("c.quality_status").isin("PASS", "THIN") & F.col("p.quality_status").isin("PASS", "THIN")
    t = F.col("c.parity_maturity")
    value = F.col("c.mid") - F.col("p.mid") - (F.col("c.underlying_price") * F.exp(-F.col("c.dividend_yield") * t) - F.col("strike") * F.exp(-F.col("c.risk_free_rate") * t))
    return both.select("underlying", "expiry", "strike", F.col("c.row_id").alias("call_row"), F.col("p.row_id").alias("put_row"), F.when(usable, value).alias("residual"),
                       F.when(usable, "OK").otherwise("NOT_EVALUABLE").alias("status"), F.when(~usable & (F.col("c.exercise_style") == "AMERICAN"), "AMERICAN_PARITY_NOT_EXACT").otherwise("").alias("reason"))


def chain_quality(quotes: DataFrame) -> DataFrame:
    """underlying, n, quality: PASS if all pass, else NOT_EVALUABLE if any is, else THIN_OR_REJECT."""
    s = F.col("quality_status")
    return quotes.groupBy("underlying").agg(F.count("*").alias("n"), F.when(F.every(s == "PASS"), "PASS").when(F.some(s == "NOT_EVALUABLE"), "NOT_EVALUABLE").otherwise("THIN_OR_REJECT").alias("quality"))


def covered_calls(quotes: DataFrame, anchors: DataFrame, fees: list[float | None]) -> DataFrame:
    """Per anchor (underlying, anchor_no, anchor_price, reference_units) and fee: the nearest eligible call and what it would bring.

    Nearest strike, then spread, then days, then row. Calls are reduced to the best of each strike; anchors and strikes of an underlying then stand in one
    order, where only the last strike up to an anchor and the first one from it on can be nearest. Never actionable. No call,
    no fee or a multiplier that is not positive is NOT_EVALUABLE with its reason, not a number.
    """
    calls = quotes.filter((F.col("option_type") == "CALL") & F.col("quality_status").isin("PASS", "THIN") & F.col("strike").isNotNull())
    carried = ["row_id", "mid", "contract_multiplier", *[c for c in ("expiry", "bid", "ask", "quality_status") if c in quotes.columns]]
    best = calls.groupBy("underlying", "strike").agg(F.min_by(F.struct("strike", F.coalesce("spread_to_mid", F.lit(float("inf"))).alias("spread"), "dte", *carried), F.struct(F.coalesce("spread_to_mid", F.lit(float("inf"))), "dte", "row_id")).alias("q"))
    line = anchors.select("underlying", F.col("anchor_price").cast("double").alias("at"), F.struct("anchor_no", "anchor_price", "reference_units").alias("anchor")).unionByName(best.select("underlying", F.col("strike").alias("at"), "q"), allowMissingColumns=True)
    own = Window.partitionBy("underlying").orderBy("at")
    sides = line.withColumn("below", F.last("q", ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first("q", ignorenulls=True).over(own.rangeBetween(0, Window.unboundedFollowing))).filter("anchor is not null")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.strike") - F.col("at")).alias("gap"), F.col(f"{c}.spread"), F.col(f"{c}.dte"), F.col(f"{c}.row_id")))
    nearer = F.when(F.col("below").isNull() | (rank("above") < rank("below")), F.col("above")).otherwise(F.col("below"))
    out = sides.select("underlying", "anchor.*", nearer.alias("m"), F.explode(F.array(*[F.lit(f).cast("double") for f in fees])).alias("fee"))
    mult, units = F.col("m.contract_multiplier"), F.col("reference_units")
    reason = F.when(F.col("m").isNull(), "NO_VALID_CALL_QUOTE").when(F.coalesce(mult, F.lit(0.0)) <= 0, "INVALID_MULTIPLIER").when(F.col("fee").isNull(), "FEE_UNKNOWN").otherwise("")
    contracts = F.when(mult > 0, F.floor(F.greatest(units, F.lit(0)) / mult)).cast("long")
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "COUNTERFACTUAL_ONLY").otherwise("NOT_EVALUABLE")).withColumn("contracts", contracts)
    out = out.withColumn("premium", F.when(F.col("reason") == "", F.col("m.mid") * mult * F.col("contracts") - F.col("fee") * F.col("contracts")))
    flags = {"actionable": F.lit(False), "auto_triggered": F.lit(False)}
    return out.withColumns(flags).select("underlying", "anchor_no", "anchor_price", "reference_units", "fee", F.col("m.row_id").alias("call_row"), *[F.col(f"m.{c}").alias(c) for c in carried[3:]], F.col("m.strike").alias("strike"), F.col("m.mid").alias("mid"), mult.alias("contract_multiplier"), "contracts", "premium",
                                        F.when((F.col("reason") == "") & (units != 0), F.col("m.strike") + F.col("premium") / units).alias("effective_exit"), "status", "reason", *flags)


def sale_rule(states: DataFrame, quality: DataFrame) -> DataFrame:
    """Units each state would sell, its covered-call status and the invariants. states.state_id is the chain's underlying."""
    s = states.join(quality.select(F.col("underlying").alias("state_id"), "quality"), "state_id", "left")
    bad = F.when((F.col("price") <= 0) | (F.col("protection_floor") <= 0) | (F.col("lot_size") <= 0), "STATE_PRICE_FLOOR_AND_LOT_MUST_BE_POSITIVE").when((F.col("hard_risk_count") < 0) | (F.col("base_sale_units") < 0), "STATE_COUNTS_MUST_BE_NON_NEGATIVE")
    lots = lambda x: F.floor(x / F.col("lot_size")) * F.col("lot_size")
    s = s.withColumn("input_error", bad).withColumn("floor_active", (F.col("price") < F.col("protection_floor")) & (F.col("hard_risk_count") < 2))
    base = lots(F.col("base_sale_units"))
    units = F.when(F.col("input_error").isNotNull(), None).when(F.col("floor_active"), 0).when(F.col("price") >= F.col("protection_floor"), F.greatest(F.lit(0), lots(base * F.col("risk_overlay_multiplier")))).otherwise(F.greatest(F.lit(0), base)).cast("long")
    s = s.withColumn("sale_units", units).withColumn("covered_call_status", F.when(F.col("quality") == "PASS", "HUMAN_REVIEW_ONLY").otherwise("DISABLED"))
    checks = F.create_map(F.lit("FLOOR_HELD"), ~F.col("floor_active") | (F.col("sale_units") == 0), F.lit("UNITS_NON_NEGATIVE"), F.col("sale_units") >= 0, F.lit("WHOLE_LOTS"), F.col("sale_units") % F.col("lot_size") == 0,
                          F.lit("CALLS_NOT_AUTOMATIC"), F.col("covered_call_status").isin("DISABLED", "HUMAN_REVIEW_ONLY"), F.lit("NO_ORDER"), F.lit(True))
    ok = F.forall(F.map_values(checks), lambda x: F.coalesce(x, F.lit(False)))
    return s.select("state_id", "price", "protection_floor", "floor_active", "sale_units", "covered_call_status", "input_error", F.when(F.col("input_error").isNull() & ok, "PASS").otherwise("FAIL").alias("invariants"))
