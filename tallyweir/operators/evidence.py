"""Fingerprints, hashes, manifests and snapshots of what was read and written."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import ResearchPolicy
from .gates import ResearchClosed


def content_hash(df: DataFrame):
    """An order-free hash of all rows."""
    return F.bit_xor(F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if t.startswith(("map", "array", "struct")) else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]))


def panel_fingerprint(panel: DataFrame) -> DataFrame:
    return panel.groupBy("panel_id").agg(F.count("*").alias("n_rows"), F.count_distinct("dt").alias("n_dates"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.concat_ws(",", F.sort_array(F.collect_set("asset"))).alias("assets"), content_hash(panel).alias("content_hash"))


def universe_hash(panel: DataFrame) -> DataFrame:
    return panel.groupBy("panel_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_set("asset"))), 256).alias("universe_hash"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, content_hash, status per table; an empty table is a failure."""
    rows = [df.agg(F.count("*").alias("n_rows"), content_hash(df).alias("content_hash")).select(F.lit(n).alias("name"), "n_rows", "content_hash") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("n_rows") > 0, "OK").otherwise("EMPTY_OUTPUT"))


def require_outputs(manifest_: DataFrame) -> None:
    """Raises if a table of the manifest is empty."""
    empty = [r["name"] for r in manifest_.filter("status <> 'OK'").collect()]  # a row per table
    if empty:
        raise ResearchClosed("EMPTY_OUTPUT:" + ",".join(empty))


def policy_hash(policy: ResearchPolicy) -> str:
    return hashlib.sha256(json.dumps(asdict(policy), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def pre_registration(df_session, rules: list[str], p: ResearchPolicy = ResearchPolicy()) -> DataFrame:
    """One row that a run writes before any result: what will be tried, validated and never selected."""
    row = {"primary_validation": "ANCHORED_WALK_FORWARD", "secondary_validation": "CPCV_PURGED_EMBARGOED", "challengers": rules, "parameter_budget": p.parameter_budget, "policy_hash": policy_hash(p),
           "selection_rule": "REPORT_STABILITY_REGIONS; NEVER_SELECT_PEAK_RETURN; NO_AUTO_PROMOTION", "policy": json.dumps(asdict(p), sort_keys=True)}
    return df_session.createDataFrame([row], "primary_validation string, secondary_validation string, challengers array<string>, parameter_budget int, policy_hash string, selection_rule string, policy string")


def written(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> DataFrame:
    """Writes each table once below folder, in the order given, and tells what was written: name, n_rows, content_hash, files, bytes, status.

    Rows and hash are observed while the rows go to the writer, files and bytes are read from what lies in the folder, so nothing is computed twice. An
    existing table is an error (errorifexists). An empty one is EMPTY_OUTPUT. fmt: parquet, json (a document a line) or csv; csv holds no nested columns.
    """
    rows, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        seen = Observation(f"written_{name}")
        df.observe(seen, F.count("*").alias("n_rows"), F.coalesce(content_hash(df), F.lit(0).cast("long")).alias("content_hash")).write.mode("errorifexists").format(fmt).option("header", True).save(f"{folder}/{name}")
        rows.append((name, int(seen.get["n_rows"]), int(seen.get["content_hash"])))
    told = spark.createDataFrame(rows, "name string, n_rows long, content_hash long")
    sizes = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(f"{folder}/{n}").filter("length > 0").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("name", F.lit(n)) for n in tables])
    return told.join(sizes, "name").withColumn("status", F.when(F.col("n_rows") > 0, "OK").otherwise("EMPTY_OUTPUT"))


def quote_snapshot(quotes: DataFrame) -> DataFrame:
    """One row: quotes by status, a hash of them and the locks."""
    by = quotes.groupBy("quality_status").agg(F.count("*").alias("n"), content_hash(quotes.select("row_id", "quality_status", "reasons")).alias("h"))
    out = by.agg(F.sum("n").alias("n_rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality_status", "n")))).alias("counts"), F.bit_xor("h").alias("content_hash"))
    return out.withColumns({k: F.lit(v) for k, v in (("evidence_only", True), ("order_created", False), ("auto_trigger", False))})
