"""Every registered query of the library's own operators. Its DuckDB SQL is in oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pricing
from ..operators import allocate, backtest, evidence, gates, quotes, risk, scan, splits
from ..schemas import SPLIT, ResearchPolicy
from ..sources import files, fixtures
from ..sources.scratch import materialize, scratch_folder
from .oracles import ORACLES  # noqa: F401
from .research import RULES, Research

P = ResearchPolicy()
AS_OF = "2001-12-31"
SIMPLE = ["equal_weight", "inverse_volatility"]
FEES = [5.0, None]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(digits: int = 8) -> Callable[[Query], Query]:
    """Registers a query under its function's name; doubles are rounded for comparison."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        return f

    return add


def _run(spark: SparkSession, sf_dir: str, rules: list[str] = SIMPLE) -> Research:
    """The flow over the one panel by ship flag."""
    panel = fixtures.panel(spark, sf_dir)
    return Research(panel, fixtures.benchmark(panel), fixtures.current(panel), AS_OF, rules, P, ["SHIPFLAG"])


def _runs(spark: SparkSession, sf_dir: str, rules: list[str] = SIMPLE) -> Research:
    """The flow over the panels by supplier, of which two fail their gate."""
    panels = materialize(fixtures.panels(spark, sf_dir), "panels")
    return Research(panels, fixtures.equal_weights(panels), fixtures.ranked_weights(panels), AS_OF, rules, P, close=False)


# --- sources, gates, splits -----------------------------------------------------------------------------------------


@query()
def panel_load(spark, d):
    p = fixtures.panel(spark, d)
    wide = p.groupBy(F.col("dt").alias("date")).pivot("asset", fixtures.ASSETS).agg(F.first("ret"))
    return files.wide_to_panel(wide, "SHIPFLAG", fixtures.ASSETS)


@query()
def weights_align(spark, d):
    p = fixtures.panel(spark, d)
    own = fixtures.current(p).filter("asset <> 'NO'").select("asset", "weight", F.lit(1).alias("row_id"))
    later = own.filter("asset = 'AF'").select("asset", (F.col("weight") * 2).alias("weight"), F.lit(2).alias("row_id"))
    alien = own.filter("asset = 'AF'").select(F.lit("ZZ").alias("asset"), "weight", "row_id")
    return gates.align_weights(own.unionByName(later).unionByName(alien), p)


@query()
def chain_load(spark, d):
    q = quotes.typed(fixtures.raw_quotes(spark, d), fixtures.AS_OF)
    return q.select("row_id", "underlying", "option_type", "exercise_style", "currency", "strike", "bid", "ask", "volume", "open_interest", "mid")


@query()
def policy_explode(spark, d):
    states, anchors, _ = files.states_and_anchors(fixtures.policies(spark, d))
    return states.join(anchors, "state_id").select("state_id", "price", "protection_floor", "hard_risk_count", "risk_overlay_multiplier", "anchor_no", "anchor_price", "reference_units")


@query()
def panel_fingerprint(spark, d):
    return evidence.panel_fingerprint(fixtures.panel(spark, d)).drop("content_hash")


@query()
def universe_hash(spark, d):
    return evidence.universe_hash(fixtures.panel(spark, d))


@query()
def panel_gate(spark, d):
    p = fixtures.panel(spark, d)
    last = p.agg(F.date_sub(F.max("dt"), 1).cast("string")).first()[0]
    runs = {"open": (p, AS_OF, 252), "late": (p, last, 252), "short": (p, AS_OF, 100_000), "hole": (p.filter("not (asset = 'NO' and obs_no = 5)"), AS_OF, 252), "twice": (p.unionByName(p.filter("asset = 'AF' and obs_no = 7")), AS_OF, 252), "narrow": (p.filter("asset = 'AF'"), AS_OF, 252)}
    out = None
    for name, (panel, as_of, n) in runs.items():
        one = gates.panel_gate(panel, as_of, n).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def next_tradable(spark, d):
    calendar = files.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt")).distinct()
    orders = files.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"))
    nxt = gates.next_tradable(orders.select("dt").distinct(), calendar)
    return orders.join(nxt, "dt").select("o_orderkey", F.col("dt").alias("order_dt"), "next_dt", "status")


@query()
def exec_alignment(spark, d):
    return backtest.execution(fixtures.panel(spark, d), P).select("split_id", "decided_at", "execute_at", "first_test", "aligned")


@query()
def wf_splits(spark, d):
    p = fixtures.panel(spark, d)
    rows = splits.walk_forward_rows(p, "train", P).withColumn("role", F.lit("train")).unionByName(splits.walk_forward_rows(p, "test", P).withColumn("role", F.lit("test")))
    return splits.membership(rows)


@query()
def cpcv_splits(spark, d):
    return splits.membership(splits.purged(fixtures.panel(spark, d), P))


@query()
def split_disjoint(spark, d):
    p = fixtures.panel(spark, d)
    wf = splits.walk_forward_rows(p, "train", P).withColumn("role", F.lit("train")).unionByName(splits.walk_forward_rows(p, "test", P).withColumn("role", F.lit("test")))
    return splits.disjoint(wf).unionByName(splits.disjoint(splits.purged(p, P)).withColumn("train_first", F.lit(None).cast("boolean")))


# --- risk -----------------------------------------------------------------------------------------------------------


@query(10)
def asset_vol(spark, d):
    return risk.volatility(_run(spark, d).cov).select("split_id", "asset", "n", "vol")


@query(10)
def pair_cov(spark, d):
    return _run(spark, d).cov.select("split_id", "a", "b", "n", "cov")


@query()
def pair_corr(spark, d):
    return risk.correlation(_run(spark, d).cov).select("split_id", "a", "b", "corr")


@query(6)
def pair_dist(spark, d):
    return risk.correlation(_run(spark, d).cov).select("split_id", "a", "b", "dist")


@query()
def cvar(spark, d):
    return risk.tail_mean(_run(spark, d).test(), ["split_id", "asset"], -F.col("ret"), "cvar95")


@query()
def drawdown_path(spark, d):
    port = fixtures.panel(spark, d).groupBy("panel_id", "obs_no").agg(F.avg("ret").alias("ret"))
    return risk.drawdown_path(port, ["panel_id"]).select("obs_no", "log_wealth", "drawdown")


@query()
def cdar(spark, d):
    path = risk.drawdown_path(_run(spark, d).test(), ["split_id", "asset"])
    return risk.tail_mean(path, ["split_id", "asset"], -F.col("drawdown"), "cdar95")


METRICS = ["total_return", "cagr", "vol", "max_drawdown", "cvar", "cdar", "turnover", "cost"]


@query(6)
def perf_metrics(spark, d):
    r = _run(spark, d, ["equal_weight"])
    return backtest.evaluation(r.held(), r.test(), P).select("split_id", *METRICS)


@query()
def tracking_error(spark, d):
    r = _run(spark, d)
    delta = r.allocations().join(r.bench.withColumnRenamed("weight", "bench"), ["panel_id", "asset"]).withColumn("d", F.col("weight") - F.col("bench"))
    return risk.tracking_error(delta, r.cov, backtest.RULE).select("split_id", "challenger", "te")


@query()
def turnover(spark, d):
    r = _run(spark, d)
    target = r.allocations().filter("asset <> 'RO'")
    keys = target.select(*backtest.RULE).distinct()
    previous = r.current.join(keys, "panel_id").filter("asset <> 'AF'")
    return risk.turnover(previous, target, backtest.RULE).select("split_id", "challenger", "turnover")


@query(6)
def challenge_matrix(spark, d):
    r = _run(spark, d)
    return backtest.challenge_matrix(r.evaluated(), [*SIMPLE, "min_cdar"], r.panel).drop("panel_id")


@query(6)
def challenge_stability(spark, d):
    r = _run(spark, d)
    matrix = backtest.challenge_matrix(r.evaluated(), [*SIMPLE, "min_cdar"], r.panel)
    return backtest.with_stability(matrix, backtest.stability(r.held(), P)).select("panel_id", "challenger", "n_splits", "median_cagr", "status", "median_l1", "max_l1", "share_stable", "region")


@query()
def stability(spark, d):
    return backtest.stability(_run(spark, d).held(), P).drop("panel_id")


@query(10)
def lw_shrinkage(spark, d):
    return risk.shrinkage(_run(spark, d).train()).select("split_id", "n", "p", "mu", "shrinkage")


@query(10)
def shrunk_mean(spark, d):
    return risk.shrunk_mean(_run(spark, d).train()).select("split_id", "asset", "m")


@query()
def cvar_contribution(spark, d):
    r = _run(spark, d)
    weights = r.allocations().filter("challenger = 'inverse_volatility'").select(*SPLIT, "asset", "weight")
    return risk.tail_contribution(r.train(), weights).select("split_id", "asset", "contribution")


# --- allocation -----------------------------------------------------------------------------------------------------


@query()
def alloc_equal(spark, d):
    return allocate.build("equal_weight", _run(spark, d).cov, None).select("split_id", "asset", "weight", "status")


@query()
def alloc_invvol(spark, d):
    return allocate.build("inverse_volatility", _run(spark, d).cov, None).select("split_id", "asset", "weight", "status", "message")


@query()
def alloc_hrp(spark, d):
    return allocate.build("hierarchical_risk_parity", _run(spark, d).cov, None).select("split_id", "asset", "weight", "status")


@query(12)
def cluster_variance(spark, d):
    cov = _run(spark, d).cov
    clusters = cov.filter("a = b").select(*SPLIT, F.col("a").alias("asset"), F.substring("a", 1, 1).alias("cluster"))
    return allocate.cluster_variance(cov, clusters, [*SPLIT, "cluster"]).select("split_id", "cluster", "variance")


def _searched(name: str):
    def run(spark, d):
        r = _run(spark, d)
        return allocate.build(name, r.cov, r.train()).select("split_id", "asset", "weight", "status")

    run.__name__ = {"risk_budget_cvar": "alloc_rb_cvar", "min_cdar": "alloc_min_cdar", "shrunk_mean_risk": "alloc_mean_risk"}[name]
    return query()(run)


for _name in ("risk_budget_cvar", "min_cdar", "shrunk_mean_risk"):
    _searched(_name)


@query()
def candidate_scores(spark, d):
    """Every transfer of an eighth from equal weights, scored by CDaR on the test windows."""
    rows = _run(spark, d).test()
    wide = allocate._wide(rows)
    start = rows.select(*SPLIT).distinct().withColumn("w", F.array(*[F.lit(1 / 6)] * 6)).withColumn("h", F.lit(0.125))
    return allocate.score_cdar(allocate.candidates(start), wide).select("split_id", "i", "j", "score")


@query()
def normalize_weights(spark, d):
    r = _run(spark, d)
    raw = r.cov.filter("a = b").select(*SPLIT, F.col("a").alias("asset"), F.when(F.col("split_no") % 5 == 1, 0.0).when((F.col("split_no") % 5 == 2) & (F.col("a") == "AF"), -0.1).when((F.col("split_no") % 5 == 3) & (F.col("a") == "AO"), None).otherwise(F.col("n") * F.length("a") + F.ascii("a")).cast("double").alias("weight"))
    return gates.normalize_long_only(raw, SPLIT).select("split_id", "asset", "weight", "status")


@query()
def drift_weights(spark, d):
    p = fixtures.panel(spark, d)
    last = p.withColumn("last", F.max("obs_no").over(Window.partitionBy("panel_id"))).filter("obs_no = last").select("panel_id", "asset", "ret")
    return gates.drift_weights(fixtures.current(p), last)


# --- constraints and evaluation -------------------------------------------------------------------------------------


@query()
def cap_te(spark, d):
    r = _run(spark, d)
    return backtest.cap_tracking_error(r.allocations(), r.bench, r.cov, P.te_cap).select("split_id", "challenger", "asset", "weight", "te_before", "te_after", "te_binding")


@query()
def cap_turnover(spark, d):
    return _run(spark, d).held().select("split_id", "challenger", "asset", "weight", "turnover_requested", "turnover", "turnover_binding")


@query()
def constraint_diag(spark, d):
    return backtest.constraint_diagnostics(_run(spark, d).held()).drop("panel_id", "split_no", "te_after", "te_binding", "turnover_binding")


@query()
def portfolio_return(spark, d):
    r = _run(spark, d)
    return backtest.portfolio_returns(r.held(), r.test()).select("split_id", "challenger", "dt", "ret")


@query()
def differential(spark, d):
    r = _run(spark, d)
    held, test = r.held(), r.test()
    return backtest.differential(backtest.portfolio_returns(held, test), backtest.portfolio_returns_folded(held, test), P.tolerance).select("split_id", "challenger", "days", "status")


@query(6)
def walk_forward(spark, d):
    return _run(spark, d).evaluated().select("split_id", "challenger", *METRICS, "te_before", "te_after", "te_binding", "turnover_binding", "differential_status")


@query(6)
def walk_forward_report(spark, d):
    r = _run(spark, d)
    return backtest.report(r.evaluated(), r.execution(), r.test(), r.allocations()).select("panel_id", "split_id", "challenger", "status", "signal_time", "execution_time", "test_end", "total_return", "turnover", "differential_status")


@query(6)
def cpcv(spark, d):
    return _run(spark, d).cpcv().select("split_id", "challenger", *METRICS, "te_before")


@query()
def filter_trace(spark, d):
    r = _run(spark, d)
    return backtest.filter_trace(r.allocations(), r.panel).select("split_id", "challenger", "reason", "threshold", "observed", "evidence_gap")


@query()
def rejected_candidates(spark, d):
    r = _run(spark, d)
    return backtest.rejected(backtest.filter_trace(r.allocations(), r.panel), [*SIMPLE, "min_cdar"], r.panel).drop("panel_id")


@query(6)
def shadow_replay(spark, d):
    r = _run(spark, d)
    return backtest.replay(r.evaluated(), r.execution(), r.panel, r.test()).drop("panel_id", "snapshot_hash")


@query(10)
def attribution(spark, d):
    r = _run(spark, d)
    return backtest.attribution(r.held(), r.test(), P).select("split_id", "challenger", "dt", "component", "value", "classification", "net", "identity_status")


@query()
def latest_targets(spark, d):
    return backtest.latest_targets(_run(spark, d).held()).drop("panel_id")


@query()
def decision_snapshot(spark, d):
    r = _run(spark, d)
    return backtest.snapshot(r.panel, backtest.latest_targets(r.held()), r.bench, r.current, r.execution(), P)


@query()
def output_manifest(spark, d):
    """What was written, as observed by the write."""
    r = _run(spark, d)
    return evidence.written({"panel": r.panel, "allocations": r.allocations(), "splits": splits.walk_forward(r.panel, P)}, scratch_folder(spark, "run"))


# --- many panels, and all six rules ---------------------------------------------------------------------------------


@query()
def panels_gate(spark, d):
    return _runs(spark, d).gate


@query(6)
def panels_matrix(spark, d):
    return _runs(spark, d).matrix().select("panel_id", "challenger", "n_splits", "status", "median_cagr", "worst_drawdown", "max_turnover", "all_pass", "median_l1", "share_stable", "region")


@query(6)
def panels_report(spark, d):
    return _runs(spark, d).report().select("panel_id", "split_id", "challenger", "status", "signal_time", "execution_time", "test_end", "total_return", "cdar", "turnover")


@query()
def panels_trace(spark, d):
    return _runs(spark, d).trace().select("panel_id", "split_id", "challenger", "stage", "reason", "observed")


@query()
def panels_rejected(spark, d):
    return _runs(spark, d).rejected()


@query()
def panels_targets(spark, d):
    return backtest.latest_targets(_runs(spark, d).held())


@query(6)
def panels_cpcv(spark, d):
    return _runs(spark, d).cpcv().select("panel_id", "split_id", "challenger", "status", "total_return", "turnover", "te_before")


@query()
def panels_next_tradable(spark, d):
    """Order times of the day, by a seventh of the customers, and the next opening (09:30) of the panel of that number."""
    days = fixtures.panels(spark, d).select("panel_id", "dt").distinct()
    opens = days.select("panel_id", (F.col("dt").cast("timestamp") + F.make_dt_interval(hours=F.lit(9), mins=F.lit(30))).alias("dt"))
    asked = files.table(spark, d, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 7).cast("string")).alias("panel_id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("dt")).distinct()
    return gates.next_tradable(asked, opens, ["panel_id"])


@query(6)
def price_quantile(spark, d):
    """The exact 95 % quantile of all prices by return flag, selected without holding a flag's prices."""
    return risk.selected_quantile(files.table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"))


@query(6)
def six_matrix(spark, d):
    return _run(spark, d, RULES).matrix().drop("panel_id")


@query(6)
def six_report(spark, d):
    return _run(spark, d, RULES).report().select("split_id", "challenger", "status", "signal_time", "execution_time", "test_end", *METRICS, "te_before", "differential_status")


@query(6)
def six_cpcv(spark, d):
    return _run(spark, d, RULES).cpcv().select("split_id", "challenger", "status", *METRICS)


@query()
def six_trace(spark, d):
    return _run(spark, d, RULES).trace().select("split_id", "challenger", "rule_id", "reason", "method", "evidence_gap")


# --- quotes ---------------------------------------------------------------------------------------------------------


def _typed(spark, d):
    return quotes.typed(fixtures.raw_quotes(spark, d), fixtures.AS_OF)


def _checked(spark, d):
    return quotes.checked(_typed(spark, d))


def _validated(spark, d):
    return materialize(quotes.validated(fixtures.raw_quotes(spark, d), fixtures.AS_OF), "validated")


def _only(column: str, codes: list[str]):
    return F.concat_ws(";", F.filter(column, lambda x: x.isin(codes)))


@query()
def quote_time(spark, d):
    return _checked(spark, d).select("row_id", _only("errors", ["FUTURE_EVIDENCE", "AVAILABLE_BEFORE_OBSERVED"]).alias("reasons"))


@query()
def quote_staleness(spark, d):
    return _checked(spark, d).select("row_id", "quote_age", "source_age", _only("warnings", ["QUOTE_STALE", "SOURCE_STALE"]).alias("reasons"))


@query(10)
def quote_maturity(spark, d):
    return _typed(spark, d).select("row_id", "maturity", "dte")


@query()
def quote_enums(spark, d):
    return _checked(spark, d).select("row_id", _only("errors", ["INVALID_OPTION_TYPE", "INVALID_EXERCISE_STYLE", "CURRENCY_NOT_HKD"]).alias("reasons"))


@query()
def quote_numeric(spark, d):
    """Every thirteenth row gets a word for its strike, every seventeenth a blank bid."""
    raw = fixtures.raw_quotes(spark, d).withColumn("strike", F.when(F.col("row_id") % 13 == 0, "none").otherwise(F.col("strike"))).withColumn("bid", F.when(F.col("row_id") % 17 == 0, "").otherwise(F.col("bid")))
    q = quotes.checked(quotes.typed(raw, fixtures.AS_OF))
    return q.select("row_id", _only("errors", ["NON_NUMERIC_STRIKE", "NON_FINITE_STRIKE", "INVALID_BID_ASK"]).alias("reasons"))


@query()
def quote_market(spark, d):
    return _checked(spark, d).select("row_id", "mid", "spread_to_mid", _only("errors", ["INVALID_BID_ASK", "CROSSED_MARKET"]).alias("errors"), _only("warnings", ["SPREAD_WIDE"]).alias("warnings"))


@query()
def quote_liquidity(spark, d):
    return _checked(spark, d).select("row_id", _only("warnings", ["OPEN_INTEREST_THIN", "VOLUME_THIN"]).alias("reasons"))


@query(6)
def quote_bounds(spark, d):
    return _checked(spark, d).filter("lower_bound is not null").select("row_id", "lower_bound", "upper_bound", _only("errors", ["MID_OUTSIDE_NO_ARBITRAGE_BOUNDS"]).alias("reasons"))


@query(6)
def bs_price(spark, d):
    q = _typed(spark, d)
    vol = 0.05 + (F.col("row_id") % 30) * 0.05
    price = pricing.black_scholes(F.col("option_type") == "CALL", *[F.col(c) for c in ("underlying_price", "strike", "maturity", "risk_free_rate", "dividend_yield")], vol)
    return q.select("row_id", price.alias("price"))


@query(6)
def implied_vol(spark, d):
    return _validated(spark, d).filter("model = 'BLACK_SCHOLES'").select("row_id", F.col("iv.bid").alias("iv_bid"), F.col("iv.mid").alias("iv_mid"), F.col("iv.ask").alias("iv_ask"))


@query(6)
def iv_repriced(spark, d):
    """Prices at the volatilities found for bid, mid and ask."""
    q = _validated(spark, d).filter("model = 'BLACK_SCHOLES' and iv.ask is not null")
    price = lambda v: pricing.black_scholes(F.col("option_type") == "CALL", *[F.col(c) for c in ("underlying_price", "strike", "maturity", "risk_free_rate", "dividend_yield")], F.col(f"iv.{v}"))
    return q.select("row_id", *[price(v).alias(f"at_{v}") for v in ("bid", "mid", "ask")])


@query(6)
def iv_band(spark, d):
    return _validated(spark, d).filter("model = 'BLACK_SCHOLES'").select("row_id", "theoretical", "model_residual", _only("errors", ["IV_BAND_NON_MONOTONIC"]).alias("errors"), _only("warnings", ["IMPLIED_VOL_NO_ROOT", "MODEL_RESIDUAL_HIGH"]).alias("warnings"))


@query()
def quote_dispatch(spark, d):
    return _checked(spark, d).select("row_id", "model")


@query()
def quote_quality(spark, d):
    return _validated(spark, d).select("row_id", "quality_status", "reasons", "evidence_only", "actionable", "auto_order")


@query()
def quality_counts(spark, d):
    return _validated(spark, d).groupBy("quality_status").agg(F.count("*").alias("n"))


@query()
def chain_quality(spark, d):
    return quotes.chain_quality(_validated(spark, d))


@query(6)
def parity(spark, d):
    return quotes.parity(_validated(spark, d)).drop("expiry")


@query(6)
def covered_call_cf(spark, d):
    _, anchors, _ = files.states_and_anchors(fixtures.policies(spark, d))
    return quotes.covered_calls(_validated(spark, d), anchors.withColumnRenamed("state_id", "underlying"), FEES).drop("expiry")


@query()
def sale_rule(spark, d):
    states, _, _ = files.states_and_anchors(fixtures.policies(spark, d))
    return quotes.sale_rule(states, quotes.chain_quality(_validated(spark, d))).drop("input_error")


@query()
def evidence_snapshot(spark, d):
    return evidence.quote_snapshot(_validated(spark, d))


# --- scans ----------------------------------------------------------------------------------------------------------


def _texts(spark, d):
    docs = files.table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"), "text")
    pages = files.table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    talks = files.table(spark, d, "conversations").select(F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return docs.unionByName(pages).unionByName(talks)


@query()
def scan_text(spark, d):
    return scan.scan_text(_texts(spark, d))


@query()
def scan_paths(spark, d):
    return scan.scan_paths(files.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path")))


@query()
def scan_summary(spark, d):
    return scan.summary(scan.scan_text(_texts(spark, d)))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["challenge_matrix"](spark, sf_dir)
