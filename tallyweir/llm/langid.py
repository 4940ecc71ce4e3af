"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are character pairs and triples of the lower-cased text, every run of non-letters being one space.
Each hashes to a row of an embedding table; a text is the mean of its rows, and a linear softmax reads it.
Table and softmax are trained together by stochastic gradient descent in numpy on a bounded, stratified
sample of labelled rows. A held-back fifth of the sample sets the softmax temperature and the score below
which a prediction is rejected. Predicting is a narrow map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BUCKETS = 1 << 16
_tables: dict[str, np.ndarray] = {}


@dataclass
class Model:
    """logits: BUCKETS x languages, the product of embeddings and softmax weights."""

    languages: list[str]
    logits: np.ndarray
    temperature: float
    reject_below: float


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["letters"]


def subwords(text: str) -> np.ndarray:
    """Buckets of the text's character pairs and triples; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = _letters()[points]
    if not keep.any():
        return np.zeros(0, np.uint16)
    c = np.full(len(points) + 2, 32, np.uint32)
    c[1:-1] = np.where(keep, points, np.uint32(32))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]  # one space for a run
    pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    triple = pair[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate([pair, triple])
    both ^= both >> np.uint32(15)
    return ((both * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dims: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """rows: language, buckets, their shares (summing to 1). Deterministic for given rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    table, weights = rng.normal(0, 1 / dims, (BUCKETS, dims)), np.zeros((dims, len(languages)))
    held, own = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    steps, done = max(1, epochs * len(own)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            language, at, share = own[i]
            x = share @ table[at]
            error = softmax(x @ weights)
            error[number[language]] -= 1
            step = rate * (1 - done / steps)
            back = weights @ error
            weights -= step * np.outer(x, error)
            table[at] -= (step * min(50.0, 1 / float((share * share).sum()))) * np.outer(share, back)
            done += 1
    logits = table @ weights
    z = np.array([share @ logits[at] for _, at, share in held]).reshape(len(held), len(languages))
    truth = np.array([number[r[0]] for r in held], dtype=int)
    best = (np.inf, 1.0)
    for t in 2.0 ** np.arange(-1, 4.5, 0.5):  # the temperature that makes the held-back rows likeliest
        p = softmax(z / t)[np.arange(len(held)), truth]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    p = softmax(z / best[1])
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    # at most one in a thousand right predictions may fall below, and a coin toss is never accepted
    chance = 1 / max(1, len(languages))
    reject = min(float(np.quantile(right, 0.001)), (1 + chance) / 2) if len(right) else 0.0
    return Model(languages, logits.astype(np.float32), best[1], max(reject * 0.9, chance))


def sample(docs: DataFrame, usable: Column, per_language: int = 600, seed: int = 3) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About per_language labelled rows of each language, by hash of doc_id, as bucket shares (at most BUCKETS each)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(per_language / n))]) if counts else None
    if rate is None:
        return []
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000.0

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [np.unique(subwords(t or ""), return_counts=True) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "at": [a.astype(np.int32) for a, _ in got], "n": [n.astype(np.int32) for _, n in got]})

    rows = labelled.filter(draw < rate[F.col("lang")]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInPandas(features, "doc_id long, lang string, at array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], len(r["at"]), sum(r["n"])))
    return [(r["lang"], np.array(r["at"]), np.array(r["n"]) / sum(r["n"])) for r in rows if r["at"]]


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 600) -> Model:
    """Learns from text and lang of the rows usable holds for (all by default). per_language bounds the sample."""
    return train(sample(docs, F.lit(True) if usable is None else usable, per_language))


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """Columns carry, then lang_pred, score (0 to 1), accepted.

    Null, empty and letterless texts, and any text under a model without languages: `und`, score 0, not
    accepted. Repeated rows and null doc_ids are predicted like any other. Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    names = list(carry)
    source = docs.select(*[F.col(c).alias(f"__tw_{k}") for k, c in enumerate(names)], *[F.col("text").alias("__tw_text")] * ("text" not in names))
    at_text = names.index("text") if "text" in names else len(names)

    def score(text: str | None, m: Model) -> tuple[str, float, bool]:
        at = subwords(text) if text and m.languages else ()
        if not len(at):
            return UNKNOWN, 0.0, False
        z = (np.bincount(at, minlength=BUCKETS).astype(np.float32) @ m.logits if len(at) > BUCKETS else m.logits[at].sum(axis=0)) / len(at) / m.temperature
        p = np.exp(z - z.max())
        best = min(1.0, float(p.max() / p.sum()))
        return m.languages[int(z.argmax())], best, best >= m.reject_below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [score(t, m) for t in batch.column(at_text).to_pylist()]
            new = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[f"__tw_{k}" for k in range(len(names))] + ["lang_pred", "score", "accepted"])

    made = T.StructType(source.schema.fields[: len(names)]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    out = source.mapInArrow(run, made)
    return out.select(*[F.col(f"__tw_{k}").alias(c) for k, c in enumerate(names)], "lang_pred", "score", "accepted")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
