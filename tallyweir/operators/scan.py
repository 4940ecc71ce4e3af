"""Scans of texts and paths for secrets and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rules of the content scan.
RULES = {
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "GitHub token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "AWS access key": r"AKIA[0-9A-Z]{16}",
    "assigned API secret": r"(?i)(api[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*['\x22][^'\x22]{8,}['\x22]",
    "email address": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "mainland phone number": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])",
}
# What a path may not end in or contain.
BLOCKED_EXTENSIONS = [".pdf", ".xlsx", ".xls", ".docx", ".pptx", ".m4a", ".png", ".jpg", ".jpeg", ".heic"]
BLOCKED_FRAGMENTS = ["holdings", "positions", "cost_basis", "vesting", "rsu", "broker", "account_statement", "mortgage", "private_data"]


def scan_text(texts: DataFrame) -> DataFrame:
    """source, id, rule of texts (source, id, text): a row per rule that a text breaks."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in RULES.items()]))
    return texts.select("source", "id", F.explode(hits).alias("rule"))


def scan_paths(paths: DataFrame) -> DataFrame:
    """id, blocked, fragments of paths (id, path). A blocked extension ends the scan of its file."""
    low = F.lower(F.coalesce("path", F.lit("")))
    blocked = F.regexp_extract(low, r"\.[^./]+$", 0).isin(BLOCKED_EXTENSIONS)
    found = F.concat_ws(";", F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in BLOCKED_FRAGMENTS])))
    return paths.select("id", blocked.alias("blocked"), F.when(blocked, "").otherwise(found).alias("fragments"))


def scan_files(files: DataFrame) -> DataFrame:
    """path, violation of read_files(): path rules first, then the text of files that are not blocked; distinct, sorted."""
    p = scan_paths(files.select(F.col("path").alias("id"), "path"))
    names = p.filter("blocked").select(F.col("id").alias("path"), F.lit("blocked extension").alias("violation")).unionByName(
        p.filter("fragments <> ''").select(F.col("id").alias("path"), F.explode(F.split("fragments", ";")).alias("violation")))
    open_ = files.join(p.filter("not blocked").select(F.col("id").alias("path")), "path", "left_semi")
    texts = scan_text(open_.filter("text is not null").select(F.lit("file").alias("source"), F.col("path").alias("id"), "text")).select(F.col("id").alias("path"), F.col("rule").alias("violation"))
    binary = open_.filter("text is null").select("path", F.lit("not UTF-8").alias("violation"))
    return names.unionByName(texts).unionByName(binary).distinct().orderBy("path", "violation")


def summary(violations: DataFrame) -> DataFrame:
    """source, rule, n_texts of scan_text()."""
    return violations.distinct().groupBy("source", "rule").agg(F.count("*").alias("n_texts"))


def verdict(violations: DataFrame) -> DataFrame:
    """One row: PASS iff there is no violation."""
    return violations.agg(F.when(F.count("*") == 0, "PASS").otherwise("FAIL").alias("verdict"), F.count("*").alias("n_violations"))
