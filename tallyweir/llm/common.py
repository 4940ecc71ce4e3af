"""Shared helpers of the corpus operators.

Documents are identified by ``(doc_id, text hash)``: a table may repeat a doc_id or leave it null, and
rows that agree in both are copies of one document, so joins on the pair never multiply rows that differ.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Longs of the bitmap by which sieved() tells rows apart: the bound of what it broadcasts.
SIEVE_WORDS = 1 << 18

_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of its own and any other is refused."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyweir-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _scratch.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    Spark deletes a finished job's shuffle files once the driver's garbage collector finds that nothing refers to
    them; it is asked to look now, as a long chain of jobs would otherwise keep the files of all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df. Only once nothing that reads df is still to run."""
    _scratch.remove(df.scratch_path)
    delete(df.sparkSession, [df.scratch_path])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables; the list is emptied. Only for tables that no open DataFrame reads."""
    while paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch_made(into: list[str]) -> Iterator[None]:
    """Collects the scratch tables made meanwhile."""
    mark = len(_scratch)
    try:
        yield
    finally:
        into += _scratch[mark:]
        del _scratch[mark:]


def quoted(name: str) -> Column:
    """The column of that very name, whatever dots or ticks it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def key_of(docs: DataFrame) -> Column:
    """What names a document beside its doc_id: 0 where doc_ids are all there and differ, else the hash of the text."""
    shared = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("k")).filter("k > 1 or doc_id is null")
    return F.lit(0).cast("long") if shared.isEmpty() else text_key()


def keyed(docs: DataFrame, *more: Column, th: Column | None = None) -> DataFrame:
    """doc_id (long, may be null), th (hash of the text, or what key_of() gave), text (never null) and what else is asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text_key() if th is None else th).alias("th"), text_of().alias("text"), *more)


def same(left: DataFrame, right: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("doc_id", "th")) -> DataFrame:
    """Null-safe equi join on keys; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = one if on is None else on & one
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def sieved(rows: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("doc_id", "th"), how: str = "left_semi") -> DataFrame:
    """The rows whose (doc_id, th), or what by names, is among keys and a few others, so that a join with keys need not shuffle texts it drops. left_anti: all other rows.

    A bit for each key's hash is set in a bitmap of SIEVE_WORDS longs, which is broadcast. Its size does not grow with the
    keys; with very many of them it lets more rows through, never fewer. Null doc_ids are keys like others.
    """
    h = F.xxhash64(*by)
    word, bit = h.bitwiseAND(F.lit(SIEVE_WORDS - 1)), F.shiftrightunsigned(h, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = keys.groupBy(word.alias("__tw_word")).agg(F.bit_or(one).alias("__tw_bits"))
    return rows.join(F.broadcast(bitmap), (word == F.col("__tw_word")) & (F.getbit("__tw_bits", bit) == 1), how)


def keep_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs, columns unchanged, whose (doc_id, text hash) is among keys (or is not: left_anti)."""
    right = keys.select(F.col("doc_id").alias("__tw_id"), F.col("th").alias("__tw_th")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id")) & (text_key() == F.col("__tw_th"))
    return docs.join(right, on, how)


def one_row_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs, columns unchanged, for each (doc_id, text hash) of rows, which has a row per row of docs.

    Only rows that repeat the pair are shuffled; of rows that differ elsewhere the one of the least hash stays.
    """
    row = F.struct(*[quoted(c) for c in docs.columns])
    counted = materialize(rows.groupBy("doc_id", "th").count(), "row_counts")
    alone, repeated = keep_rows(docs, counted.filter("count = 1")), keep_rows(docs, counted.filter("count > 1"))
    picked = repeated.groupBy(F.col("doc_id").cast("long").alias("__tw_id"), text_key().alias("__tw_th")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("x"))
    return alone.unionByName(picked.select("x.*"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

