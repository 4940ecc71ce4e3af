"""A corpus pipeline: language, near duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm import chosenpath, common, decontam, langid, mixing, tokens
from tallyweir.llm.queries import TOKENIZER

_last_stage: list[str] = []
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(f: Callable) -> Callable:
    """Scratch tables of a stage go once the next one starts: a caller writes each stage's result before that, as run() does.

    Columns besides those of documents travel as one struct, so their names and types meet nothing that a stage makes.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, _last_stage)
        others = [c for c in docs.columns if c not in COLUMNS]
        packed = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*[common.quoted(c) for c in others]).alias("__tw_extra")) if others else docs
        with common.scratch_made(_last_stage):
            out = f(spark, packed, sf_dir)
        if "__tw_extra" not in out.columns:
            return out
        return out.select(*[F.col("__tw_extra")[c].alias(c) if c in others else F.col(c) for c in docs.columns])

    return run_stage


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts, learnt from a bounded sample of the labelled rows.

    Null and empty texts have no language and go. Repeated rows are judged alike. Null labels teach nothing; an empty table stays empty.
    Other columns pass untouched, whatever their names.
    """
    model = langid.fit(docs)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__tw_others")
    judged = langid.predict(docs.select("text", others), model, "text", "__tw_others").filter("accepted")
    return judged.select(*[F.col("text") if c == "text" else F.col(f"__tw_others.`{c}`") for c in docs.columns])


@_stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts: that of the least doc_id, null last.

    Of rows that repeat doc_id and text one stays. Texts without words are copies of each other only where they are equal; an empty
    table stays empty.
    """
    return common.one_row_each(docs, chosenpath.near_duplicates(docs).filter("first"))


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay, as do repeated rows; an empty table stays empty."""
    return common.keep_rows(docs, decontam.contamination(docs, common.table(spark, sf_dir, "benchmark")), "left_anti")


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix draws it, shard by shard in shuffled order.

    Rows are drawn by row, so repeated rows count each for itself. Null sources are a source of their own; texts without words have
    size 0 and are never drawn; an empty table stays empty.
    """
    named = common.materialize(docs.withColumn("__tw_rid", F.monotonically_increasing_id()), "mixed_rows")
    return mixing.mixed_documents(named, mixing.mix_sources(named, block_words=None, row_id="__tw_rid"), "__tw_rid").drop("__tw_rid")


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, as read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts are the end id alone."""
    return tokens.tokens_round_trip(docs, TOKENIZER)


STAGES = [
    ("language", known_language),
    ("near_duplicates", distinct_texts),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", token_files),
]

#: Trained models, sampled paths and hashed draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
