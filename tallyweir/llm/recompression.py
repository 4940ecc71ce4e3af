"""Long repeats of words by recompression.

Each round replaces runs of one symbol and then pairs of neighbours by new symbols, as recompression of a grammar does:
symbols are split in two classes, and a symbol of the first class next to one of the second becomes a pair. A symbol's
name is a keyed hash of what it stands for and its class is a bit of its name, so every task gives equal runs
and pairs one name without asking the others, and one Spark aggregation tells which names occur again.

Every symbol carries the range of words that its making depended on. A window that holds this range has
the symbol wherever it stands, so equal windows hold the same such symbols. A window's anchor is the one of least
hash on the highest level that has any; a window that holds none, as inside a long run, is its own
anchor. Windows that share an anchor meet in a shard, where the words themselves are compared (see repeats).
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .repeats import Method, contexts, covered, digest, digest2, finished

WIDTH = 35
ROUNDS = 6
#: Levels that give anchors, highest first. Below them a window is its own anchor.
LEVELS = (6, 4)
FAR = 1 << 40
LOW = np.uint64((1 << 24) - 1)
PIECE = 1 << 17
#: Windows of one context at most; longer runs of an anchor are cut.
CONTEXT_WINDOWS = WIDTH


def mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """A 64-bit name of two values."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else np.array([b], np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt * 0x165667B19E3779F9 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def named_runs(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Runs of one symbol become one; each depends on both neighbours, which end it."""
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    n = (last - first + 1).astype(np.uint64)
    if len(first) == len(s):
        out = s
    else:
        out = np.where(n > 1, mix(s[first], n, 2 * level), s[first])
    a, b = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    left, right = np.r_[-FAR, lo[last[:-1]]], np.r_[hi[first[1:]], FAR]
    return out, np.minimum(a, left), np.maximum(b, right)


def named_pairs(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, wall: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Neighbours of the first and second class become one; a symbol left alone depends on the neighbour it looked at."""
    second = (mix(s, 0, 2 * level + 1) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(s), bool)
    joins[:-1] = ~second[:-1] & second[1:] & ~wall[:-1] & ~wall[1:]
    joined = np.r_[False, joins[:-1]]
    after_lo, after_hi = np.r_[lo[1:], -FAR], np.r_[hi[1:], FAR]
    before_lo, before_hi = np.r_[-FAR, lo[:-1]], np.r_[FAR, hi[:-1]]
    look_lo, look_hi = np.where(second, before_lo, after_lo), np.where(second, before_hi, after_hi)
    a, b = np.minimum(lo, look_lo), np.maximum(hi, look_hi)
    named = np.where(joins, mix(s, np.r_[s[1:], s[-1:]], 2 * level + 1), s)
    keep = ~joined
    return named[keep], a[keep], b[keep], wall[keep]


def least_in_windows(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For each of n window starts the leftmost symbol of least hash whose range the window holds: the hash, with the
    symbol's number in the low bits; all ones if none."""
    none = np.iinfo(np.uint64).max
    ok = (lo > -FAR // 2) & (hi < FAR // 2) & (hi - lo <= WIDTH)
    key, a, b = mix(s[ok], 1, 99) & ~LOW | np.flatnonzero(ok).astype(np.uint64), np.maximum(hi[ok] - WIDTH, 0), np.minimum(lo[ok], n - 1)
    key, a, b = key[a <= b], a[a <= b], b[a <= b]
    span = b - a + 1
    top = np.floor(np.log2(np.maximum(span, 1))).astype(np.int64)
    out = np.full(n, none, np.uint64)
    for j in range(int(WIDTH).bit_length() - 1, -1, -1):
        own = top == j
        np.minimum.at(out, a[own], key[own])
        np.minimum.at(out, b[own] - (1 << j) + 1, key[own])
        if j:  # a start of a stretch of 2**j stands for two of half that
            half = 1 << j - 1
            out[half:] = np.minimum(out[half:], out[:-half].copy()) if len(out) > half else out[half:]
    return out


def word_anchors(words: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window that starts at each word: whether it has an anchor, its name and where it stands; walls stand
    between texts."""
    n = len(words)
    s, lo, hi = words.copy(), np.arange(n), np.arange(n) + 1
    s[wall] = np.arange(int(wall.sum()), dtype=np.uint64)  # walls never make a run
    lo[wall], hi[wall] = -FAR, FAR
    kept: dict[int, tuple] = {}
    w = wall
    for level in range(1, ROUNDS + 1):
        if level == 1:
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            s, lo, hi = named_runs(s, lo, hi, level)
            w = w[first]
        s, lo, hi, w = named_pairs(s, lo, hi, w, level)
        if level in LEVELS:
            kept[level] = (s, lo, hi)
    has, name, place = np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for level in LEVELS:
        s, lo, hi = kept[level]
        found = least_in_windows(s, lo, hi, n)
        new = np.flatnonzero(~has & (found != np.iinfo(np.uint64).max))
        which = (found[new] & LOW).astype(np.int64)
        has[new], name[new], place[new] = True, mix(s[which], level, 3), which * ROUNDS + level
    return has, name, place


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Words of all texts end to end, a wall after each; long texts in overlapping pieces."""
    pieces = []
    for k, text in enumerate(texts):
        own = text.split()
        pieces += [(k, off, own[off : off + PIECE + WIDTH - 1]) for off in range(0, len(own) - WIDTH + 1, PIECE)]
    out = []
    while pieces:
        group, held = [], 0
        while pieces and held < PIECE:
            group.append(pieces.pop())
            held += len(group[-1][2]) + 1
        flat = [w for x in group for w in (*x[2], b"")]
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        lengths = np.array([len(x[2]) + 1 for x in group])
        ends = np.cumsum(lengths)
        wall = np.zeros(len(flat), bool)
        wall[ends - 1] = True
        has, anchor, place = word_anchors(words, wall)
        owner = np.repeat(np.arange(len(group)), lengths)
        ok = np.arange(len(flat)) <= (ends - 1 - WIDTH)[owner]
        for i in np.flatnonzero(ok & ~has).tolist():  # the window names itself
            anchor[i], place[i] = xxhash.xxh3_64_intdigest(b" ".join(flat[i : i + WIDTH]), 11), -1 - i  # a seed apart from that of context digests
        at, n = contexts(anchor, place, owner, ok, CONTEXT_WINDOWS)
        who = owner[at]
        context = np.array([digest(b" ".join(flat[a : a + c + WIDTH - 1])) for a, c in zip(at.tolist(), n.tolist(), strict=True)], np.int64)
        number, shift = np.array([x[0] for x in group]), np.array([x[1] for x in group]) - (ends - lengths)
        out.append((number[who], at + shift[who], n, anchor[at].view(np.int64), context))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def cut(text: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a : a + n + WIDTH - 1]) for a, n in places]


def judge(contexts: list[bytes], times: np.ndarray) -> tuple[list, list]:
    """Windows of the contexts are compared word by word; those that occur more than once are covered."""
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in c.split()] for c in contexts]
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.int32)
    n = lengths - WIDTH + 1
    at = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[at[owner] + place])
    _, group = np.unique(view.view(np.dtype((np.void, 4 * WIDTH))).ravel(), return_inverse=True)
    often = (np.bincount(group, weights=times[owner]) > 1)[group]
    cuts = np.cumsum(n)[:-1]
    lo, hi = zip(*[covered(f, WIDTH) for f in np.split(often, cuts)], strict=True)
    return list(lo), list(hi)


def windows(data: bytes) -> list[tuple[int, int]]:
    words = data.split()
    return [digest2(b" ".join(words[i : i + WIDTH])) for i in range(len(words) - WIDTH + 1)]


METHOD = Method(WIDTH, 4096, 300_000, 1 << 20, anchors, cut, judge, windows)


def dedup_words(docs: DataFrame, method: Method = METHOD, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (words joined by a space): a row per input row.

    Null texts have no words; texts under 35 words lose nothing, as do empty tables. Rows that repeat a document repeat
    its windows, so their words go in both. Only doc_id and text are read.
    """

    def row(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        words = data.split()
        edges = [0, *[x for s in spans for x in s], len(words)]
        left = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
        kept = b" ".join(left)
        return (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * text)

    return finished(docs, method, row, "n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
