"""The scenario search, merged moments, the scan of return paths and exact quantiles against plain versions."""

import random
from datetime import date, timedelta
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.operators import allocate, risk, simplex, splits
from tallyweir.schemas import SPLIT, ResearchPolicy

DAYS = [date(2024, 1, 2) + timedelta(days=i) for i in range(400)]
LATTICE = np.array([(a, b, 20 - a - b) for a, b in product(range(21), repeat=2) if a + b <= 20]) / 20


def make(spark, assets, days=400, offset=0.0, seed=7):
    rng = random.Random(seed)
    rows = [("P", i, DAYS[i], a, offset + (rng.gauss(0.0003, 0.004 * (k + 1)) if a != "CASH" else 0.00008)) for i in range(days) for k, a in enumerate(assets)]
    return spark.createDataFrame(rows, "panel_id string, obs_no long, dt date, asset string, ret double")


@pytest.fixture(scope="module")
def panel(spark):
    return make(spark, ["A", "B", "C"]).cache()


@pytest.mark.parametrize("name", ["min_cdar", "risk_budget_cvar", "shrunk_mean_risk"])
def test_search_is_no_worse_than_a_lattice(spark, panel, name):
    """Scored by the search's own objective on all splits, and for the drawdown by SQL on the weights that come back."""
    rows = splits.walk_forward_rows(panel, "train").cache()
    got = allocate.build(name, risk.train_covariance(panel), rows).collect()
    assert {r.status for r in got} == {"OK"} and all(r.message.startswith("objective=") for r in got)
    wide = {k: np.array([r.r for r in simplex.by_day(rows.filter(F.col("split_no") == k)).orderBy("obs_no").collect()]).T.copy() for k in (0, 1)}
    for k, r in wide.items():
        w = np.array([x.weight for x in sorted(got, key=lambda x: x.asset) if x.split_no == k])
        score = {"min_cdar": simplex.cdar, "risk_budget_cvar": simplex.cvar_budget, "shrunk_mean_risk": simplex.mean_risk(*simplex.shrunk_inputs(r))}[name]
        of = lambda x: score(x @ r, x, r)  # noqa: B023, E731
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and of(w[None, :])[0] <= of(LATTICE).min() + 1e-12
        if name == "min_cdar":
            con = duckdb.connect()
            con.register("paths", rows.filter(F.col("split_no") == k).select("obs_no", "asset", "ret").toPandas())
            con.register("own", __import__("pandas").DataFrame({"asset": ["A", "B", "C"], "w": w}))
            q = """with p as (select obs_no, sum(ret * w) r from paths join own using (asset) group by 1), l as (select obs_no, sum(ln(1 + r)) over (order by obs_no) l from p),
                   d as (select 1 - exp(l - max(l) over (order by obs_no)) d from l), t as (select quantile_cont(d, 0.95) q from d) select avg(d) from d, t where d >= q - 1e-15"""
            assert abs(con.execute(q).fetchone()[0] - of(w[None, :])[0]) < 1e-10


def test_search_reaches_corners_and_inner_points():
    r = np.random.default_rng(3).normal(0, 0.01, (6, 50))
    for goal in ([1, 0, 0, 0, 0, 0], [0, 0.4, 0.3, 0.2, 0.1, 0]):
        w, value, rounds = simplex.pair_search(r, lambda p, w, r: ((w - np.array(goal)) ** 2).sum(axis=1), [np.full(6, 1 / 6)])  # noqa: B023
        assert np.abs(w - goal).max() < 1e-3 and value < 1e-6 and rounds < simplex.ROUNDS


def test_many_assets_are_searched_in_blocks():
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, (60, 200)) * np.linspace(0.2, 2, 60)[:, None]
    mean, cov = simplex.shrunk_inputs(r)
    w, value, rounds = simplex.pair_search(r, simplex.mean_risk(mean * 0, cov), [np.full(60, 1 / 60)])
    inverse = np.linalg.inv(cov)
    best = inverse.sum(axis=1) / inverse.sum()
    assert rounds < simplex.ROUNDS and value <= 8 * best @ cov @ best * (1 + (0.02 if best.min() >= 0 else 1.0))


def test_search_needs_whole_scenarios(spark, panel):
    spoilt = panel.withColumn("ret", F.when((F.col("asset") == "B") & (F.col("obs_no") == 5), float("nan")).otherwise(F.col("ret")))
    for df in (spoilt, panel.filter("not (asset = 'C' and obs_no = 9)")):
        got = allocate.build("min_cdar", risk.train_covariance(df), splits.walk_forward_rows(df, "train")).collect()
        assert got and {(r.status, r.weight) for r in got} == {("NOT_EVALUABLE", None)}


# --- moments --------------------------------------------------------------------------------------------------------


def covariances(df):
    return {(r.split_no, r.a, r.b): r.cov for r in df.collect()}


def test_moments_far_from_zero(spark):
    near, far = make(spark, ["A", "B", "CASH"]), make(spark, ["A", "B", "CASH"], offset=1e6)
    one, two = covariances(risk.train_covariance(near)), covariances(risk.train_covariance(far))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-12
    assert all(two[k] == 0 for k in two if "CASH" in k)


def test_segments_give_the_purged_covariance(spark, panel):
    p = ResearchPolicy(min_train=100)
    direct = covariances(risk.covariance(splits.purged(panel, p).filter("role = 'train'")))
    merged = covariances(risk.purged_covariance(panel, p))
    assert len(direct) == 15 * 9 and direct.keys() == merged.keys() and max(abs(direct[k] - merged[k]) for k in direct) < 1e-15


def test_an_embargo_longer_than_a_fold(spark, panel):
    p = ResearchPolicy(min_train=1, embargo=80, test_folds=1)
    rows = splits.purged(panel, p).select("split_id", "role", "obs_no").distinct().collect()
    for s in {r.split_id for r in rows}:
        test = {r.obs_no for r in rows if r.split_id == s and r.role == "test"}
        assert {r.obs_no for r in rows if r.split_id == s and r.role == "train"} == {o for o in range(400) if min(abs(o - t) for t in test) > 80}


@pytest.mark.parametrize("tile", [2, 64])
def test_tiles_equal_covar_samp(spark, monkeypatch, tile):
    """Assets that lack some observations, in tiles of two and in one; and ranges of 100 observations."""
    monkeypatch.setattr(risk, "TILE", tile)
    monkeypatch.setattr(risk, "RANGE", 100)
    rows = make(spark, list("ABCDE")).filter("not (asset = 'C' and obs_no % 3 = 0) and not (asset = 'E' and obs_no < 150)").withColumns({"split_no": F.lit(0), "split_id": F.lit("X")})
    got = {(r.a, r.b): (r.n, r.cov) for r in risk.covariance(rows).collect()}
    x = rows.select("obs_no", F.col("asset").alias("a"), F.col("ret").alias("x")).join(rows.select("obs_no", F.col("asset").alias("b"), F.col("ret").alias("y")), "obs_no")
    want = {(r.a, r.b): (r.n, r.c) for r in x.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-15 for k in want)


def test_covariance_of_many_assets(spark):
    """700 assets are 11 tiles a side."""
    r = np.random.default_rng(5).normal(0, 0.01, (25, 700))
    rows = spark.createDataFrame([("P", 0, "X", t, f"a{k:04d}", float(r[t, k])) for t in range(25) for k in range(700)], "panel_id string, split_no int, split_id string, obs_no long, asset string, ret double")
    got = risk.covariance(rows).select("a", "b", "cov").toPandas()
    k, m = got["a"].str[1:].astype(int).to_numpy(), got["b"].str[1:].astype(int).to_numpy()
    assert len(got) == 700 * 700 and np.abs(np.cov(r.T)[k, m] - got["cov"].to_numpy()).max() < 1e-16


# --- paths and quantiles --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_paths_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(risk, "PIECE", piece)
    rng = random.Random(2)
    rets = {"a": [rng.gauss(0, 0.02) for _ in range(60)], "lost": [0.1, -0.2, 0.3, -1.0, 0.5, 0.1, 0.2], "more than all": [0.1, -1.5, 2.0], "first": [-1.0, 0.1]}
    df = spark.createDataFrame([(k, i, r) for k, v in rets.items() for i, r in enumerate(v)], "k string, obs_no long, ret double")
    got = {(r.k, r.obs_no): r for r in risk.return_path(df, ["k"]).collect()}
    assert len(got) == sum(map(len, rets.values()))
    for k, v in rets.items():
        wealth, peak, gone = 1.0, 0.0, False
        for i, r in enumerate(v):
            gone = gone or r <= -1
            wealth = 0.0 if gone else wealth * (1 + r)
            peak = max(peak, wealth)
            row = got[k, i]
            assert row.lost == gone and abs(row.drawdown - (-1.0 if gone else wealth / peak - 1)) < 1e-12


def test_a_total_loss_is_no_gain(spark):
    df = spark.createDataFrame([("P", i, r, 0.0) for i, r in enumerate([-1.0, 0.1])], "panel_id string, obs_no long, ret double, turnover double")
    got = risk.performance(df, ["panel_id"], 10.0).first()
    assert (got.total_return, got.cagr, got.max_drawdown, got.cdar) == (-1.0, -1.0, -1.0, 1.0)


@pytest.mark.parametrize("tail", [0.0, 0.5, 0.95, 1.0])
def test_selected_quantile_equals_percentile(spark, tail):
    rng = random.Random(6)
    rows = [("spread", rng.gauss(0, 1)) for _ in range(500)] + [("ties", float(i % 3)) for i in range(200)] + [("same", 2.5)] * 40 + [("one", -1.0), ("two", 1.0), ("two", 3.0), ("far", 1e300)] + [("far", rng.random()) for _ in range(99)] + [("ties", None), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: (r.n, r.q) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.lit(tail)).alias("q")).collect() if r.n}
    for buckets in (1, 16, 1024):
        got = {r.k: (r.n, r.q) for r in risk.selected_quantile(df, ["k"], F.col("v"), tail, buckets).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1e-12 * max(1, abs(want[k][1])) for k in want)


def test_budget_and_skipped_splits(spark, panel):
    assert splits.max_paths(ResearchPolicy(), 6) == 24 and splits.max_paths(ResearchPolicy(), 7) == 21 and splits.max_paths(ResearchPolicy(), 30) == 1
    p = ResearchPolicy(min_train=258)
    counted = splits.skipped_splits(panel, p).first()
    kept = {r.split_id for r in splits.purged(panel, p).select("split_id").distinct().collect()}
    assert counted.n_splits == 15 and counted.n_skipped == 15 - len(kept) and 0 < len(kept) < 15
    assert len({r.split_no for r in splits.splits_of_segments(panel, ResearchPolicy(min_train=1, parameter_budget=7), 3).collect()}) == 6


def test_candidates_still_score(spark, panel):
    rows = splits.walk_forward_rows(panel, "test")
    start = rows.select(*SPLIT).distinct().withColumn("w", F.array(*[F.lit(1 / 3)] * 3)).withColumn("h", F.lit(0.125))
    assert allocate.score_cdar(allocate.candidates(start), allocate._wide(rows)).count() == 2 * 7
