"""Token ids in a byte-aligned variable-length binary format.

Ids are renumbered by falling frequency, so common ids take one byte. A block holds the ids of whole
documents as two separate streams: control bytes (two bits an id: its length less one) and data bytes
(little end first). Decoding looks the four lengths of a control byte up in a 256 x 4 numpy table and gathers
all ids of a block at once. Blocks are rows of a Parquet table, which gives the format Spark's committed,
any-store writes; the rank table stands beside them.
"""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions, scratch_path, text_key, text_of

#: A block closes once it holds as many ids; one longer document still makes one block.
BLOCK_IDS = 1 << 18
#: Pieces whose ids a worker remembers.
CACHE = 1_000_000
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.int64)

_workers: dict[str, tuple] = {}


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.asarray(values, dtype=np.int64)
    extra = (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.int64)
    padded[: len(v)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    at = np.cumsum(extra + 1) - extra - 1
    data = np.zeros(int((extra + 1).sum()), dtype=np.uint8)
    for k in range(4):
        long = extra >= k
        data[at[long] + k] = v[long] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    out = raw[at] if n else np.zeros(0, np.int64)
    for k in range(1, 4):
        long = lengths > k
        out[long] |= raw[at[long] + k] << 8 * k
    return out


class Encoder:
    """Whole-text ids of a byte-level BPE tokenizer, remembering the ids of space-separated pieces.

    Byte-level BPE never merges across the space that opens a word, nor between a letter and the punctuation after
    it, so a text without two adjacent white spaces and without special-token marks is the concatenation of its
    pieces' ids; other texts go whole. New pieces are encoded many in one string and told apart by their bytes.
    """

    TAIL = ".,;:!?%&*#$|)"
    TOGETHER = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # ids of a space and the key
        self.whole = re.compile(r"\s\s|<\|")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, new: list[str]) -> None:
        if "" in self.known or "" not in new:
            plain = new
        else:
            self.known[""] = self.ids(" ").tobytes()
            plain = [c for c in new if c]
        together = [" " + " ".join(plain[k : k + self.TOGETHER]) for k in range(0, len(plain), self.TOGETHER)]
        got = np.fromiter((i for x in self.tokenizer.encode_batch_fast(together, add_special_tokens=False) for i in x.ids), np.uint32)
        ends = np.cumsum(pc.binary_length(pa.array(plain, pa.large_string())).to_numpy() + 1)
        cuts = 4 * (np.searchsorted(np.cumsum(self.sizes[got]), ends) + 1)
        flat = got.tobytes()
        self.known.update((c, flat[i:j]) for c, i, j in zip(plain, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))

    def _ids_of(self, cores: list[str]) -> list[bytes]:
        """Ids of a space and each of these different words."""
        new = [c for c in cores if c not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = cores
        if new:
            self._learn(new)
        return [self.known[c] for c in cores]

    def _parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Words without the punctuation behind their last letter, and that punctuation."""
        cores = pc.utf8_rtrim(words, self.TAIL)
        cores = pc.if_else(pc.match_substring_regex(cores, r"\p{L}$"), cores, words)
        whole = pc.equal(pc.binary_length(cores), pc.binary_length(words))
        tails = pc.if_else(whole, "", pc.extract_regex(words, f"(?P<tail>[{re.escape(self.TAIL)}]*)$").field("tail"))
        return cores.dictionary_encode(), tails.dictionary_encode()

    def many(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None if t and not self.whole.search(t) else self.ids(t) for t in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        if not plain:
            return out
        pieces = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        words, ends = pieces.values.dictionary_encode(), pieces.offsets.to_numpy()
        number = words.indices.to_numpy()
        core, tail = self._parts(words.dictionary)
        # two units a piece: its word and the punctuation behind it
        units = np.empty((len(number), 2), np.int64)
        units[:, 0] = core.indices.to_numpy()[number]
        units[:, 1] = tail.indices.to_numpy()[number] + len(core.dictionary)
        known = self._ids_of(core.dictionary.to_pylist()) + [self.ids(t).tobytes() for t in tail.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat, start = np.frombuffer(b"".join(known), np.uint32), np.cumsum(size) - size
        n = size[units]
        n[ends[:-1]] = 0  # the first piece of a text has no space before it
        n, units = n.ravel(), units.ravel()
        at = np.repeat(start[units] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids = flat[at]
        cuts = np.r_[0, np.cumsum(n)][2 * ends]
        for k, i in enumerate(plain):
            own, first = ids[cuts[k] : cuts[k + 1]], texts[i].split(" ", 1)[0]
            out[i] = np.concatenate([self.ids(first), own]) if first else own
        return out


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def forget() -> None:
    """Gives back what encoders hold in this worker: workers are used again by other stages, which need the memory."""
    if _workers:
        _workers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)


def _planes(values: np.ndarray, width: int) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def _unplanes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _in_groups(many, texts: list[str], size: int = 1 << 23) -> Iterator[np.ndarray]:
    """many() of texts, about size characters at a time."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield from many(group)
            group, held = [], 0
    if group:
        yield from many(group)


def tokenize(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Blocks in ascending doc_id order (null first, equal ids by text hash): shard, block, start (ids before it in
    the shard), n_ids, docs and raw (both byte planes: doc_id with a null mark and length; ids)."""
    spark = docs.sparkSession
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
               .repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text_key()))

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        who: list = []
        block, start, held = 0, 0, 0
        end = np.array([end_id], dtype=np.uint32)

        def close() -> pd.DataFrame:
            flat = np.concatenate(ids)
            lengths = np.array([n for _, _, n in who], dtype=np.int64)
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "n_ids": [len(flat)], "n_docs": [len(who)],
                                 "doc_ids": [_planes(np.array([d for d, _, _ in who], np.int64).view(np.uint64), 8)], "nulls": [zstandard.compress(bytes(z for _, z, _ in who))],
                                 "lengths": [_planes(lengths, 4)], "raw": [_planes(flat, 4)]})

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for d, one in zip(batch.column("doc_id").to_pylist(), _in_groups(encode.many, texts), strict=True):
                ids += [one, end]
                who.append((d or 0, d is None, len(one) + 1))
                held += len(one) + 1
                if held >= BLOCK_IDS:
                    yield close()
                    ids, who, block, start, held = [], [], block + 1, start + held, 0
        if who:
            yield close()

    def arrow(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=_arrow_schema(), preserve_index=False)

    return ordered.mapInArrow(arrow, "shard int, block long, start long, n_ids long, n_docs long, doc_ids binary, nulls binary, lengths binary, raw binary")


def _arrow_schema():
    return pa.schema([("shard", pa.int32()), *[(k, pa.int64()) for k in ("block", "start", "n_ids", "n_docs")], *[(k, pa.binary()) for k in ("doc_ids", "nulls", "lengths", "raw")]])


def frequencies(blocks: DataFrame) -> DataFrame:
    """id, n: one row per id of the vocabulary that occurs."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for pdf in batches:
            for raw in pdf["raw"]:
                c = np.bincount(_unplanes(raw, 4))
                if len(c) > len(total):
                    c, total = total, c
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at.astype(np.int64), "n": total[at].astype(np.int64)})

    return blocks.select("raw").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Tokenizes whole texts, appends end_id to each document and writes the format to out.

    Null and empty texts: the end id alone. Null doc_ids come first; repeated rows are written each. An empty
    table gives empty tables. out/ranks: rank, id. out/blocks: shard, block, start, n_ids, n_docs, doc_ids,
    nulls, lengths, control, data. The rank table is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    blocks = materialize(tokenize(docs, path, end_id), "token_blocks")
    counted = sorted(((r["n"], r["id"]) for r in frequencies(blocks).collect()), key=lambda x: (-x[0], x[1]))
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(counted)], "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(max([i for _, i in counted], default=0) + 1, np.int64)
    for k, (_, i) in enumerate(counted):
        rank[i] = k
    shared = spark.sparkContext.broadcast(rank)

    def encode(batches):
        forget()
        for pdf in batches:
            coded = [encode_ids(shared.value[_unplanes(raw, 4)]) for raw in pdf["raw"]]
            yield pdf.drop(columns="raw").assign(control=[c for c, _ in coded], data=[d for _, d in coded])

    (blocks.mapInPandas(encode, "shard int, block long, start long, n_ids long, n_docs long, doc_ids binary, nulls binary, lengths binary, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{out}/blocks"))


def read_tokens(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    ranks = spark.read.parquet(f"{out}/ranks").collect()  # bounded by the vocabulary
    table = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        table[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{out}/blocks")

    def decode(batches):
        for pdf in batches:
            for b in pdf.itertuples():
                flat = shared.value[decode_ids(b.control, b.data, b.n_ids)]
                lengths = _unplanes(b.lengths, 4).astype(np.int64)
                at = np.cumsum(lengths) - lengths
                doc = pd.array(_unplanes(b.doc_ids, 8).view(np.int64), dtype="Int64")
                doc[np.frombuffer(zstandard.decompress(b.nulls), np.uint8).astype(bool)] = pd.NA
                got = pd.DataFrame({"doc_id": doc, "shard": b.shard, "offset": b.start + at, "n_tokens": lengths,
                                    "ids_crc32": [zlib.crc32(flat[i : i + n].astype("<u4").tobytes()) for i, n in zip(at, lengths, strict=True)]})
                if ids:
                    got["ids"] = [flat[i : i + n].astype(np.int64) for i, n in zip(at, lengths, strict=True)]
                yield got

    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per shard
    read = blocks.mapInPandas(decode, "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    return read.join(base, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def tokens_round_trip(docs: DataFrame, path: str, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Writes the format to the shared folder and returns what is read back from it."""
    out = scratch_path(docs.sparkSession, "token_files")
    write_tokens(docs, path, out, end_id)
    return read_tokens(docs.sparkSession, out, ids)
