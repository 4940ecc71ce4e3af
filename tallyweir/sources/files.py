"""Readers of panels, weights, chains, policies and texts, and writers that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import QUOTE_FIELDS
from .numbering import numbered

CHAIN = T.StructType([T.StructField(c, T.StringType()) for c in QUOTE_FIELDS])
ANCHOR = "struct<price: double, reference_units: int>"
POLICY = f"state_id string, price double, protection_floor double, hard_risk_count int, base_sale_units int, risk_overlay_multiplier double, lot_size int, anchors array<{ANCHOR}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_to_panel(wide: DataFrame, panel_id: str, assets: list[str]) -> DataFrame:
    """A date column `date` and one column per asset become panel rows; obs_no counts the distinct dates."""
    long = wide.withColumn("dt", F.col("date").cast("date")).unpivot(["dt"], assets, "asset", "ret").withColumn("ret", F.col("ret").cast("double"))
    dates = numbered(long.select("dt").distinct(), F.col("dt"), name="obs_no")
    return long.join(dates, "dt").select(F.lit(panel_id).alias("panel_id"), "obs_no", "dt", "asset", "ret")


def read_panel(spark: SparkSession, path: str, panel_id: str) -> DataFrame:
    """A wide CSV with a `date` column."""
    head = spark.read.option("header", True).csv(path)
    if "date" not in head.columns:
        raise ValueError("MISSING_COLUMNS:date")
    return wide_to_panel(head, panel_id, [c for c in head.columns if c != "date"])


def read_weights(spark: SparkSession, path: str, panel_id: str | None = None) -> DataFrame:
    """A weight CSV with `asset` and `weight`: asset, weight and row_id, the place in the file, as align_weights() takes them (the last of repeated assets counts)."""
    have = spark.read.option("header", True).csv(path).columns
    if not {"asset", "weight"} <= set(have):
        raise ValueError("WEIGHT_FILE_REQUIRES_ASSET_WEIGHT")
    rows = _in_order(spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in have])).option("header", True).csv(path))
    out = rows.select("asset", F.col("weight").cast("double").alias("weight"), "row_id")
    return out if panel_id is None else out.withColumn("panel_id", F.lit(panel_id))


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with row_id, the ordinal over all files by name and place in the file: counts per file and place first, then offsets."""
    at = rows.withColumns({"__tw_file": F.col("_metadata.file_path"), "__tw_start": F.col("_metadata.file_block_start"), "__tw_row": F.monotonically_increasing_id()})
    return numbered(at, F.col("__tw_file"), F.col("__tw_start"), F.col("__tw_row"), name="row_id").drop("__tw_file", "__tw_start", "__tw_row")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """A chain CSV, all strings, with row_id, the ordinal over all files; a missing column (vendor_iv too) is an error before anything is read."""
    have = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(QUOTE_FIELDS) - set(have))
    if missing:
        raise ValueError("MISSING_COLUMNS:" + ",".join(missing))
    return _in_order(spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in have])).option("header", True).csv(path))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY).json(path, multiLine=True)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text (null where the bytes are no UTF-8) of all files below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.when(F.is_valid_utf8("content"), F.col("content").cast("string")).alias("text"))


def states_and_anchors(policies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """states with defaults filled, one row per anchor, and reason rows for policies that lack a field or an anchor."""
    reasons = F.array_compact(F.array(
        F.when(F.col("price").isNull(), F.lit("MISSING_PRICE")), F.when(F.col("protection_floor").isNull(), F.lit("MISSING_PROTECTION_FLOOR")),
        F.when(F.coalesce(F.size("anchors"), F.lit(0)) < 1, F.lit("MISSING_ANCHORS"))))
    judged = policies.withColumn("reasons", reasons)
    good = judged.filter(F.size("reasons") == 0)
    states = good.select("state_id", "price", "protection_floor", F.coalesce("hard_risk_count", F.lit(0)).alias("hard_risk_count"), F.coalesce("base_sale_units", F.lit(0)).alias("base_sale_units"),
                         F.coalesce("risk_overlay_multiplier", F.lit(1.0)).alias("risk_overlay_multiplier"), F.coalesce("lot_size", F.lit(100)).alias("lot_size"))
    anchors = good.select("state_id", F.posexplode("anchors").alias("anchor_no", "a")).select("state_id", "anchor_no", F.col("a.price").alias("anchor_price"), F.col("a.reference_units").alias("reference_units"))
    return states, anchors, judged.filter(F.size("reasons") > 0).select("state_id", F.explode("reasons").alias("reason"))


def write_once(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Writes a table; an existing one is an error."""
    out = df.write.mode("errorifexists").format(fmt)
    (out.partitionBy(*by) if by else out).save(path)
