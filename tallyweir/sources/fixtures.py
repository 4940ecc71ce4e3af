"""Panels, chains, weights and states that Spark derives from the given tables. The SQL also runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import POLICY, table

ASSETS = ["AF", "AO", "NF", "NO", "RF", "RO"]
AS_OF = "2026-01-15 00:00:00"

PANEL = """
with d as (select distinct cast(l_shipdate as date) dt from {lineitem}),
     k as (select distinct l_returnflag||l_linestatus asset from {lineitem}),
     v as (select cast(l_shipdate as date) dt, l_returnflag||l_linestatus asset, sum(cast(round(l_extendedprice*100) as bigint)) cents from {lineitem} group by 1,2),
     g as (select d.dt, k.asset, coalesce(v.cents,0) cents from d cross join k left join v on v.dt=d.dt and v.asset=k.asset),
     m as (select asset, cast(sum(cents) as double)/count(*) mu from g group by asset)
select 'SHIPFLAG' panel_id, dense_rank() over (order by g.dt)-1 obs_no, g.dt, g.asset, 0.02*(cast(g.cents as double)/m.mu-1.0) ret from g join m on g.asset=m.asset
"""

PANELS = """
with li as (select 'S'||cast(l_suppkey%7 as varchar(1)) panel_id, cast(l_suppkey%7 as int) r, cast(l_shipdate as date) dt, 'L'||cast(least(cast(l_linenumber as int), 5) as varchar(1)) asset, l_extendedprice price from {lineitem}
       where cast(l_shipdate as date) <= case when l_suppkey%7=0 then date '1995-10-31' else date '1996-06-30'+cast(90*(l_suppkey%7) as int) end),
     v as (select panel_id, r, dt, asset, sum(cast(round(price*100) as bigint)) cents from li group by panel_id, r, dt, asset),
     d as (select panel_id, r, dt, dense_rank() over (partition by panel_id order by dt)-1 obs_no from (select distinct panel_id, r, dt from v)),
     k as (select distinct panel_id, asset from v),
     g as (select d.panel_id, d.r, d.obs_no, d.dt, k.asset, coalesce(v.cents,0) cents from d join k on d.panel_id=k.panel_id left join v on v.panel_id=d.panel_id and v.dt=d.dt and v.asset=k.asset),
     m as (select panel_id, asset, cast(sum(cents) as double)/count(*) mu from g group by panel_id, asset)
select g.panel_id, cast(g.obs_no as bigint) obs_no, g.dt, g.asset, 0.02*(cast(g.cents as double)/m.mu-1.0) ret from g join m on g.panel_id=m.panel_id and g.asset=m.asset where not (g.r=1 and g.obs_no=3 and g.asset='L5')
"""

CHAIN = """
with b as (select p_partkey k, p_brand underlying, p_type, p_size, 950.0 s,
  cast(900+(p_partkey%11)*10 as double) strike, 'CALL' option_type from {part}
  union all select p_partkey, p_brand, p_type, p_size, 950.0, cast(900+(p_partkey%11)*10 as double), 'PUT' from {part}),
c as (select *, case when option_type='CALL' then greatest(s-strike,0.0) else greatest(strike-s,0.0) end + 30.0 + 0.02*abs(strike-s) as fair from b),
e as (select *, fair * case when k%59=0 then 0.2 else 1.0 end mid0 from c)
select k*2+case when option_type='PUT' then 1 else 0 end row_id, underlying, option_type,
 case when p_type='ECONOMY' then 'AMERICAN' else 'EUROPEAN' end exercise_style,
 case when p_type='ECONOMY' then 'QUANTLIB_EXPLICIT' else 'BLACK_SCHOLES_EUROPEAN' end pricing_model,
 strike, cast(s as double) underlying_price,
 cast(case when k%37=0 then mid0*1.05 else mid0*(1.0-0.005*(k%23)) end as double) bid, cast(case when k%37=0 then mid0*0.95 else mid0*(1.0+0.005*(k%23)) end as double) ask,
 k%40 volume, (k*7)%400 open_interest, 100 contract_multiplier,
 case when k%53=0 then 'USD' else 'HKD' end currency,
 k%45-case when k%41=0 then 50 else 0 end quote_minutes_ago, 30+p_size days_to_expiry from e
"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue by ship flag as returns: panel_id, obs_no, dt, asset, ret."""
    return spark.sql(PANEL, lineitem=table(spark, sf_dir, "lineitem")).withColumn("obs_no", F.col("obs_no").cast("long"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel per seventh of the suppliers with a calendar of its own: the first is too short, the second lacks a cell, the others pass."""
    return spark.sql(PANELS, lineitem=table(spark, sf_dir, "lineitem"))


def equal_weights(panel_: DataFrame) -> DataFrame:
    own = panel_.select("panel_id", "asset").distinct()
    return own.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("panel_id")))


def ranked_weights(panel_: DataFrame) -> DataFrame:
    """Weights that fall evenly by asset and sum to one."""
    own, n = Window.partitionBy("panel_id"), F.count("*").over(Window.partitionBy("panel_id"))
    return panel_.select("panel_id", "asset").distinct().withColumn("weight", (n + 1 - F.row_number().over(own.orderBy("asset"))) / (n * (n + 1) / 2))


def benchmark(panel_: DataFrame) -> DataFrame:
    return panel_.select("panel_id", "asset").distinct().withColumn("weight", F.lit(1 / 6))


def current(panel_: DataFrame) -> DataFrame:
    """Weights (7 - rank) / 21 by asset."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ASSETS]), F.col("asset"))
    return panel_.select("panel_id", "asset").distinct().withColumn("weight", (7 - rank) / 21.0)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option quotes from part, with minutes and days relative to AS_OF."""
    return spark.sql(CHAIN, part=table(spark, sf_dir, "part"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain as an ingest would hold it: every field a string, times ISO with an offset; row_id is the ordinal."""
    minute = F.make_dt_interval(mins=F.col("quote_minutes_ago").cast("int"))
    as_of = F.lit(AS_OF).cast("timestamp")
    iso = lambda x: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    one = F.make_dt_interval(mins=F.lit(1))
    q = chain(spark, sf_dir).withColumn("t", as_of - minute)
    text = lambda c: F.col(c).cast("string").alias(c)
    return q.select(F.col("row_id").cast("long").alias("row_id"), F.concat(F.lit("E"), F.col("row_id").cast("string")).alias("source_event_id"), iso(F.col("t")).alias("observed_at"), iso(F.col("t") + one).alias("available_at"), iso(F.col("t")).alias("quote_time"),
                    iso(as_of + F.make_dt_interval(days=F.col("days_to_expiry").cast("int"))).alias("expiry"), F.lit("derived").alias("source_url"), "underlying", "option_type", "exercise_style", "pricing_model", "currency",
                    *[text(c) for c in ("strike", "bid", "ask", "volume", "open_interest", "contract_multiplier", "underlying_price")], F.lit("0.025").alias("risk_free_rate"), F.lit("0.0").alias("dividend_yield"), F.lit(None).cast("string").alias("vendor_iv"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale policy per brand, through its JSON form."""
    b = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("state_id"), b.alias("b")).distinct()
    anchors = F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(u).alias("reference_units")) for p, u in ((900, 0), (960, 1000), (990, 1000))])
    text = F.to_json(F.struct("state_id", F.lit(950.0).alias("price"), (900.0 + 10 * (F.col("b") % 11)).alias("protection_floor"), (F.col("b") % 3).alias("hard_risk_count"), F.lit(1000).alias("base_sale_units"),
                              (0.5 + 0.25 * (F.col("b") % 4)).alias("risk_overlay_multiplier"), F.lit(100).alias("lot_size"), anchors.alias("anchors")))
    return brands.select(F.from_json(text, POLICY).alias("p")).select("p.*")
