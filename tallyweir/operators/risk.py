"""Grouped risk statistics. Constant columns give exactly zero variance: moments are taken about an asset's mean, or its one value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import SPLIT, TAIL, TRADING_DAYS, ResearchPolicy
from ..sources.scratch import materialize
from .splits import segments, splits_of_segments, walk_forward

#: Assets a side of a tile of pairs, and observations of one product of two tiles: the bounds of a task's group.
TILE, RANGE = 64, 4096
#: Observations that are scanned as one piece of a return path.
PIECE = 1024


def centred(panel: DataFrame, keys: list[str]) -> DataFrame:
    """panel with x, the return less the mean of its asset; exactly 0 for an asset that never changes."""
    at = panel.groupBy(*keys, "asset").agg(F.when(F.min("ret") == F.max("ret"), F.min("ret")).otherwise(F.avg("ret")).alias("__tw_mean"))
    return panel.join(at, [*keys, "asset"]).withColumn("x", F.col("ret") - F.coalesce("__tw_mean", F.lit(0.0))).drop("__tw_mean")


def pair_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, n, ma, mb, c: observations that assets a <= b share, their means of x there and the sum of products about these means.

    Assets are dealt to tiles of TILE; each task has the observations of two tiles over RANGE observations and gives all their pairs by one matrix
    product, so a row is sent once per tile of its panel, not once per asset. Pieces are merged by merged_covariance().
    """
    names = rows.groupBy(*keys, "asset").agg(F.lit(1).alias("one"))
    own = Window.partitionBy(*keys)
    tiles = names.select(*keys, "asset", F.floor((F.row_number().over(own.orderBy("asset")) - 1) / TILE).cast("int").alias("tile"), F.ceil(F.count("*").over(own) / TILE).cast("int").alias("tiles"))
    grid = rows.join(tiles, [*keys, "asset"]).select(*keys, (F.col("obs_no") / RANGE).cast("long").alias("range"), "obs_no", "asset", "x", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    grid = grid.select(*keys, "range", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "obs_no", "asset", "x", "tile")

    def product(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        obs = np.unique(table.column("obs_no").to_numpy(), return_inverse=True)[1]
        asset = table.column("asset").combine_chunks().dictionary_encode()
        at, names_ = asset.indices.to_numpy(), np.array(asset.dictionary.to_pylist())
        x, there = np.zeros((obs.max() + 1, len(names_))), np.zeros((obs.max() + 1, len(names_)))
        x[obs, at] = table.column("x").to_numpy(zero_copy_only=False)
        there[obs, at] = 1.0
        mean = np.divide(x.sum(axis=0), there.sum(axis=0))
        d = np.where(there > 0, x - mean, 0.0)
        tile = np.zeros(len(names_), int)
        tile[at] = table.column("tile").to_numpy()
        left, right = np.flatnonzero(tile == first["i"]), np.flatnonzero(tile == first["j"])
        n = there[:, left].T @ there[:, right]
        sa, sb = d[:, left].T @ there[:, right], there[:, left].T @ d[:, right]
        with np.errstate(invalid="ignore", divide="ignore"):
            c = d[:, left].T @ d[:, right] - sa * sb / n
            ma, mb = mean[left][:, None] + sa / n, mean[right][None, :] + sb / n
        a, b = (g.ravel() for g in np.meshgrid(names_[left], names_[right], indexing="ij"))
        keep = (a <= b) & (n.ravel() > 0)
        if first["i"] != first["j"]:
            keep = n.ravel() > 0
            a, b, ma, mb = np.where(a <= b, a, b), np.where(a <= b, b, a), np.where((a <= b).reshape(ma.shape), ma, mb), np.where((a <= b).reshape(ma.shape), mb, ma)
        k = int(keep.sum())
        fixed = [pa.array([first[c_]] * k, table.schema.field(c_).type) for c_ in keys]
        return pa.table([*fixed, pa.array(a[keep].tolist(), pa.string()), pa.array(b[keep].tolist(), pa.string()), *[pa.array(v.ravel()[keep]) for v in (n, ma, mb, c)]], names=[*keys, "a", "b", "n", "ma", "mb", "c"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return grid.groupBy(*keys, "range", "i", "j").applyInArrow(product, ", ".join(f"{k} {types[k]}" for k in keys) + ", a string, b string, n double, ma double, mb double, c double")


def _pieces() -> dict[str, Column]:
    return {"n": F.col("n"), "na": F.col("n") * F.col("ma"), "nb": F.col("n") * F.col("mb"), "between": F.col("n") * F.col("ma") * F.col("mb"), "c": F.col("c")}


def merged_covariance(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b (both ways), n, cov from sums over pieces: within them c, between them the spread of their means."""
    both = F.col("c") + (F.col("between") - F.col("na") * F.col("nb") / F.col("n"))
    cov = sums.filter("n > 1").select(*keys, "a", "b", F.col("n").cast("long").alias("n"), (both / (F.col("n") - 1)).alias("cov"))
    return cov.unionByName(cov.filter("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "n", "cov"))


def train_covariance(panel: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """Sample covariance of all asset pairs in every walk-forward train window: SPLIT, a, b, n, cov.

    Train windows are nested, so the panel is summed once per step-long block and the blocks are merged.
    """
    block = F.when(F.col("obs_no") < p.min_train, 0).otherwise(F.floor((F.col("obs_no") - p.min_train) / p.step) + 1).cast("int")
    parts = pair_moments(centred(panel, ["panel_id"]).withColumn("block", block), ["panel_id", "block"]).groupBy("panel_id", "block", "a", "b").agg(*[F.sum(v).alias(k) for k, v in _pieces().items()])
    upto = Window.partitionBy("panel_id", "a", "b").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.select("panel_id", F.col("block").alias("split_no"), "a", "b", *[F.sum(c).over(upto).alias(c) for c in _pieces()])
    return merged_covariance(sums.join(walk_forward(panel, p).select(*SPLIT), ["panel_id", "split_no"]), SPLIT)


def purged_covariance(panel: DataFrame, p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """The same for the train windows of the combinatorial splits: the panel is summed once per segment, and splits add up the segments they train on."""
    parts = pair_moments(segments(centred(panel, ["panel_id"]), p), ["panel_id", "segment"]).groupBy("panel_id", "segment", "a", "b").agg(*[F.sum(v).alias(k) for k, v in _pieces().items()])
    used = splits_of_segments(panel, p).filter("role = 'train'").select(*SPLIT, "segment")
    return merged_covariance(parts.join(used, ["panel_id", "segment"]).groupBy(*SPLIT, "a", "b").agg(*[F.sum(c).alias(c) for c in _pieces()]), SPLIT)


def covariance(rows: DataFrame) -> DataFrame:
    """The same for any split rows (SPLIT, obs_no, asset, ret), straight from them."""
    parts = pair_moments(centred(rows, SPLIT), SPLIT)
    return merged_covariance(parts.groupBy(*SPLIT, "a", "b").agg(*[F.sum(v).alias(k) for k, v in _pieces().items()]), SPLIT)


def volatility(cov: DataFrame) -> DataFrame:
    """SPLIT, asset, n, vol."""
    return cov.filter("a = b").select(*SPLIT, F.col("a").alias("asset"), "n", F.sqrt(F.greatest("cov", F.lit(0.0))).alias("vol"))


def correlation(cov: DataFrame) -> DataFrame:
    """cov with corr (undefined is 0, clipped, diagonal 1) and dist, the correlation distance."""
    sd = volatility(cov)
    out = cov.join(sd.select(*SPLIT, F.col("asset").alias("a"), F.col("vol").alias("sa")), [*SPLIT, "a"]).join(sd.select(*SPLIT, F.col("asset").alias("b"), F.col("vol").alias("sb")), [*SPLIT, "b"])
    raw = F.coalesce(F.try_divide("cov", F.col("sa") * F.col("sb")), F.lit(0.0))
    corr = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    return out.withColumn("corr", corr).withColumn("dist", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("corr")) / 2)))).drop("sa", "sb")


def tail_mean(rows: DataFrame, keys: list[str], loss: Column, name: str) -> DataFrame:
    """keys, q, name: the mean of the losses at or above their 95 % quantile (linear between ranks). Groups are windows of splits; selected_quantile() serves longer ones."""
    losses = rows.select(*keys, loss.alias("loss"))
    q = losses.groupBy(*keys).agg(F.percentile("loss", F.lit(TAIL)).alias("q"))
    return losses.join(q, keys).filter(F.col("loss") >= F.col("q") - 1e-15).groupBy(*keys).agg(F.first("q").alias("q"), F.avg("loss").alias(name))


def return_path(returns: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """returns with log_wealth, drawdown and lost. The wealth before the first return is no point of the path.

    A scan in pieces of PIECE observations: each is scanned alone, what stands before it (growth, highest point, loss of everything) comes from one row a
    piece. A return of -1 or less loses everything: from that day on lost is true, the wealth 0 (its logarithm minus infinity) and the drawdown -1.
    """
    piece = [*keys, "__tw_piece"]
    inside = Window.partitionBy(*piece).orderBy("obs_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = returns.withColumns({"__tw_piece": F.floor(F.col("obs_no") / PIECE), "__tw_gone": F.col(ret) <= -1})
    here = cut.withColumns({"__tw_log": F.sum(F.when(F.col("__tw_gone"), 0.0).otherwise(F.log1p(ret))).over(inside), "__tw_lost": F.max("__tw_gone").over(inside)})
    here = here.withColumn("__tw_high", F.max(F.when(~F.col("__tw_lost"), F.col("__tw_log"))).over(inside))
    ends = here.groupBy(*piece).agg(F.max_by("__tw_log", "obs_no").alias("growth"), F.max("__tw_high").alias("high"), F.max("__tw_lost").alias("gone"))
    earlier = Window.partitionBy(*keys).orderBy("__tw_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__tw_base", F.coalesce(F.sum("growth").over(earlier), F.lit(0.0))).withColumn("__tw_over", F.coalesce(F.max("gone").over(earlier), F.lit(False)))
    ends = ends.withColumn("__tw_peak", F.max(F.when(~F.col("__tw_over"), F.col("__tw_base") + F.col("high"))).over(earlier)).select(*piece, "__tw_base", "__tw_over", "__tw_peak")
    log = F.col("__tw_base") + F.col("__tw_log")
    peak = F.greatest("__tw_peak", F.when(~F.col("__tw_over"), F.col("__tw_base") + F.col("__tw_high")))
    lost = F.coalesce(F.col("__tw_over") | F.col("__tw_lost"), F.lit(False))
    out = here.join(ends, piece).withColumns({"lost": lost, "log_wealth": F.when(lost, float("-inf")).otherwise(log), "drawdown": F.when(lost, -1.0).otherwise(F.exp(log - peak) - 1)})
    return out.drop(*[c for c in out.columns if c.startswith("__tw_")])


def drawdown_path(returns: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """return_path() without the flag."""
    return return_path(returns, keys, ret).drop("lost")


def performance(returns: DataFrame, keys: list[str], cost_bps: float) -> DataFrame:
    """keys, then total_return, cagr, vol, max_drawdown, cvar, cdar, turnover, cost of returns (keys, obs_no, ret, turnover).

    The cost of the turnover is taken from the first return only. A path that loses everything has total return and CAGR of -1.
    """
    begin = returns.groupBy(*keys).agg(F.min("obs_no").alias("__tw_first"))
    cost = F.col("turnover") * cost_bps / 1e4
    net = returns.join(begin, keys).withColumn("cost", cost).withColumn("net", F.when(F.col("obs_no") == F.col("__tw_first"), F.col("ret") - F.col("cost")).otherwise(F.col("ret"))).drop("__tw_first")
    path = materialize(return_path(net, keys, "net"), "path")  # read three times below
    years = F.greatest(F.count("*") / TRADING_DAYS, F.lit(1 / TRADING_DAYS))
    grown = F.when(F.max("lost"), 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(F.col("net") > -1, F.col("net"))))))
    facts = path.groupBy(*keys).agg((grown - 1).alias("total_return"), F.when(grown <= 0, -1.0).otherwise(F.pow(grown, 1 / years) - 1).alias("cagr"),
                                    F.when(F.count("*") <= 1, 0.0).otherwise(F.stddev_samp("net") * (TRADING_DAYS**0.5)).alias("vol"), F.min("drawdown").alias("max_drawdown"),
                                    F.first("turnover").alias("turnover"), F.first("cost").alias("cost"))
    cvar = tail_mean(path, keys, -F.col("net"), "cvar").drop("q")
    cdar = tail_mean(path, keys, -F.col("drawdown"), "cdar").drop("q")
    return facts.join(cvar, keys).join(cdar, keys)


def selected_quantile(rows: DataFrame, keys: list[str], value: Column, tail: float = TAIL, buckets: int = 1024) -> DataFrame:
    """keys, n, q: the exact quantile of value (linear between ranks) for groups of any length, nulls left out.

    percentile() keeps every different value of a group in one task. Here a histogram between the least and the largest value
    finds the buckets of the two ranks that matter; only the different values of these buckets are then counted in order.
    """
    x = materialize(rows.select(*keys, value.cast("double").alias("__tw_v")).filter("__tw_v is not null"), "quantile")
    v, r = F.col("__tw_v"), F.col("__tw_r")
    ends = x.groupBy(*keys).agg(F.count("*").alias("__tw_n"), F.min(v).alias("__tw_lo"), F.max(v).alias("__tw_hi"))
    rank = (F.col("__tw_n") - 1) * tail
    ends = ends.withColumn("__tw_r", F.floor(rank)).withColumn("__tw_share", rank - F.floor(rank))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.try_divide(v - F.col("__tw_lo"), F.col("__tw_hi") - F.col("__tw_lo")), F.lit(0.0)) * buckets)).cast("int")
    put = x.join(ends, keys).withColumn("__tw_bucket", bucket)
    counts = put.groupBy(*keys, "__tw_bucket", "__tw_r").agg(F.count("*").alias("__tw_k"))
    upto = Window.partitionBy(*keys).orderBy("__tw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("__tw_before", F.coalesce(F.sum("__tw_k").over(upto), F.lit(0)))
    wanted = held.filter((F.col("__tw_before") <= r + 1) & (F.col("__tw_before") + F.col("__tw_k") > r)).select(*keys, "__tw_bucket", "__tw_before")
    values = put.join(wanted, [*keys, "__tw_bucket"]).groupBy(*keys, "__tw_bucket", "__tw_before", "__tw_r", "__tw_share", "__tw_n", "__tw_v").agg(F.count("*").alias("__tw_k"))
    inside = Window.partitionBy(*keys, "__tw_bucket").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    last = values.withColumn("__tw_end", F.col("__tw_before") + F.sum("__tw_k").over(inside)).withColumn("__tw_first", F.col("__tw_end") - F.col("__tw_k"))
    at = lambda k: F.max(F.when((F.col("__tw_first") <= k) & (F.col("__tw_end") > k), v))
    out = last.groupBy(*keys, "__tw_n", "__tw_share").agg(at(r).alias("__tw_a"), at(r + 1).alias("__tw_b"))
    share = F.col("__tw_share")
    return out.select(*keys, F.col("__tw_n").alias("n"), F.when(share > 0, F.col("__tw_a") + share * (F.col("__tw_b") - F.col("__tw_a"))).otherwise(F.col("__tw_a")).alias("q"))


def quadratic(delta: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """keys, q = d' cov d for deltas (keys incl. SPLIT, asset, d)."""
    da = delta.select(*keys, F.col("asset").alias("a"), F.col("d").alias("da"))
    db = delta.select(*keys, F.col("asset").alias("b"), F.col("d").alias("db"))
    return da.join(db, keys).join(cov.select(*SPLIT, "a", "b", "cov"), [*SPLIT, "a", "b"]).groupBy(*keys).agg(F.sum(F.col("da") * F.col("db") * F.col("cov")).alias("q"))


def tracking_error(delta: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """keys, te: annual."""
    return quadratic(delta, cov, keys).select(*keys, F.sqrt(F.greatest("q", F.lit(0.0)) * TRADING_DAYS).alias("te"))


def turnover(previous: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One-way turnover per key of previous and target (keys, asset, weight); an asset on one side counts in full."""
    both = previous.select(*keys, "asset", F.col("weight").alias("p")).join(target.select(*keys, "asset", F.col("weight").alias("t")), [*keys, "asset"], "full")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))) / 2).alias("turnover"))


def shrinkage(rows: DataFrame) -> DataFrame:
    """SPLIT, n, p, mu, shrinkage: the Ledoit-Wolf intensity of each split's rows (population moments), in closed form."""
    centred = rows.withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy(*SPLIT, "asset")))
    pairs = centred.select(*SPLIT, "obs_no", F.col("asset").alias("a"), "x").join(centred.select(*SPLIT, "obs_no", F.col("asset").alias("b"), F.col("x").alias("y")), [*SPLIT, "obs_no"])
    s = pairs.groupBy(*SPLIT, "a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("s"))
    sums = s.groupBy(*SPLIT).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("tr"), F.count_distinct("a").alias("p"))
    norms = centred.groupBy(*SPLIT, "obs_no").agg(F.sum(F.col("x") * F.col("x")).alias("q")).groupBy(*SPLIT).agg(F.avg(F.col("q") * F.col("q")).alias("q2"), F.count("*").alias("n"))
    both = sums.join(norms, SPLIT).withColumn("mu", F.col("tr") / F.col("p"))
    d2 = (F.col("ss") - 2 * F.col("mu") * F.col("tr") + F.col("p") * F.col("mu") * F.col("mu")) / F.col("p")
    b2 = F.least(d2, (F.col("q2") - F.col("ss")) / (F.col("p") * F.col("n")))
    return both.withColumn("d2", d2).withColumn("b2", F.greatest(b2, F.lit(0.0))).select(*SPLIT, "n", "p", "mu", F.when(F.col("b2") == 0, 0.0).otherwise(F.col("b2") / F.col("d2")).alias("shrinkage"))


def shrunk_mean(rows: DataFrame, own: float = 0.35) -> DataFrame:
    """SPLIT, asset, m: the asset's mean drawn to the mean of all assets' means."""
    means = rows.groupBy(*SPLIT, "asset").agg(F.avg("ret").alias("mean"))
    return means.select(*SPLIT, "asset", (own * F.col("mean") + (1 - own) * F.avg("mean").over(Window.partitionBy(*SPLIT))).alias("m"))


def tail_contribution(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """SPLIT, asset, contribution: weight times the asset's mean loss on the portfolio's tail days; they sum to the CVaR."""
    held = rows.join(weights, [*SPLIT, "asset"])
    port = held.groupBy(*SPLIT, "obs_no").agg((-F.sum(F.col("weight") * F.col("ret"))).alias("loss"))
    q = port.groupBy(*SPLIT).agg(F.percentile("loss", F.lit(TAIL)).alias("q"))
    days = port.join(q, SPLIT).filter(F.col("loss") >= F.col("q") - 1e-15).select(*SPLIT, "obs_no")
    return held.join(days, [*SPLIT, "obs_no"]).groupBy(*SPLIT, "asset").agg(F.avg(-F.col("weight") * F.col("ret")).alias("contribution"))
