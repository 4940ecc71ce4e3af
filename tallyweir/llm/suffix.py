"""Suffix-array deduplication of byte strings.

Anchors deal the text to shards so that equal 200-byte strings meet in one (see repeats). A shard's
contexts are one string; its suffix array is built by induced sorting: suffixes are classified as smaller or larger than
their successor, the substrings between leftmost-smaller positions are sorted and named, the string of names is
sorted recursively, and all suffixes are induced from that in two linear scans. Permuted common prefixes (in text order,
each suffix with the one before it in the array, up to the threshold) then mark the repeats.

On bytes the scans run bucket by bucket in numpy; on the longer alphabets of names they are plain loops.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Method, contexts, covered, digest, digest2, finished

WIDTH = 200
#: An anchor is the least hash of the byte runs of this length in a window.
GRAM = 40
SMALL_ALPHABET = 1024
#: Windows of one context at most; longer runs of an anchor (periodic text) are cut.
CONTEXT_WINDOWS = WIDTH - GRAM + 1


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. t ends with its only least value."""
    equal = t[:-1] == t[1:]
    at = np.where(equal, len(t), np.arange(len(t) - 1))
    until = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(t), bool)
    out[:-1] = (t[:-1] < t[1:])[until]
    return out


def _deal(p: np.ndarray, t: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends p to the buckets of its values, in order."""
    if len(p):
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        for piece, value in zip(np.split(p, cuts), c[np.r_[0, cuts]].tolist(), strict=True):
            into[value].append(piece)


def _induce_buckets(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes in order. One numpy step for a bucket and run length."""
    none = np.zeros(0, np.int32)
    t, lms = t.astype(np.uint16), lms.astype(np.int32)  # 16-bit keys are sorted by counting
    starts: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(lms, t, starts)
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    left = [none] * k
    for c in range(k):
        batch, parts = np.concatenate(larger[c]) if larger[c] else none, []
        while len(batch):
            parts.append(batch)
            p = batch - 1
            p = p[(p >= 0) & ~smaller[p]]
            own = t[p] == c
            _deal(p[~own], t, larger)
            batch = p[own]
        left[c] = np.concatenate(parts) if parts else none
        if starts[c]:
            p = np.concatenate(starts[c]) - 1
            _deal(p[p >= 0], t, larger)
    less: list[list[np.ndarray]] = [[] for _ in range(k)]
    less[int(t[-1])].append(np.array([len(t) - 1], np.int32))
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        batch, parts = np.concatenate(less[c]) if less[c] else none, []
        while len(batch):
            parts.append(batch)
            p = batch - 1
            p = p[(p >= 0) & smaller[p]]
            own = t[p] == c
            _deal(p[~own], t, less)
            batch = p[own]
        p = left[c][::-1] - 1
        p = p[p >= 0]
        _deal(p[smaller[p]], t, less)
        out += [*parts, left[c][::-1]]
    return np.concatenate(out)[::-1]


def _induce_scan(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same by two scans of the array."""
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    head, tail = (tails - counts).tolist(), (tails - 1).tolist()
    s, small, n = t.tolist(), smaller.tolist(), len(t)
    sa = [-1] * n
    for i in reversed(lms.tolist()):
        c = s[i]
        sa[tail[c]] = i
        tail[c] -= 1
    for x in range(n):
        j = sa[x] - 1
        if j >= 0 and not small[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (tails - 1).tolist()
    for x in range(n - 1, -1, -1):
        j = sa[x] - 1
        if j >= 0 and small[j]:
            c = s[j]
            sa[tail[c]] = j
            tail[c] -= 1
    return np.array(sa, dtype=np.int64)


def _alike(t: np.ndarray, a: np.ndarray, b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> np.ndarray:
    """Whether t has the same lengths_a + 1 values from a and from b on."""
    same = lengths_a == lengths_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[lengths_a[live] >= k]
    return same


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Order of the suffixes of t, values below k, whose last value is its only 0."""
    if len(t) < 3:
        return np.arange(len(t))[::-1].copy()
    induce = _induce_buckets if k <= SMALL_ALPHABET else _induce_scan
    smaller = classify(t)
    leftmost = np.zeros(len(t), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(leftmost)
    first = induce(t, smaller, lms[np.argsort(t[lms], kind="stable")], k)
    ranked = first[leftmost[first]]
    length = np.zeros(len(t), np.int64)
    length[lms[:-1]] = np.diff(lms)
    alike = _alike(t, ranked[:-1], ranked[1:], length[ranked[:-1]], length[ranked[1:]])
    alike[:1] = False  # the end stands alone
    names = np.cumsum(np.r_[0, ~alike])
    if int(names[-1]) + 1 < len(lms):
        name = np.zeros(len(t), np.int64)
        name[ranked] = names
        ranked = lms[suffix_array(name[lms], int(names[-1]) + 1)]
    return induce(t, smaller, ranked, k)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of order but the first, what it shares with the one before, up to most; both have most left."""
    view = np.lib.stride_tricks.sliding_window_view(data, most)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for i in range(0, len(out), 8192):
        differ = view[order[i : i + 8192][: len(out) - i]] != view[order[i + 1 : i + 8193]]
        out[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def judge(contexts: list[bytes], times: np.ndarray, width: int = WIDTH) -> tuple[list, list]:
    """The ranges of each context that windows occurring more than once cover."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8)
    at = np.cumsum(lengths + 1) - lengths - 1
    t = raw.astype(np.int32) + 2
    t[at + lengths], t[-1] = 1, 0
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    place = np.arange(len(owner)) - at[owner]
    starts = np.zeros(len(t), bool)
    starts[: len(owner)] = place <= (lengths - width)[owner]
    order = suffix_array(t, 258)
    order = order[starts[order]]
    new = np.r_[True, common_prefixes(raw, order, width) < width][: len(order)]
    group = np.cumsum(new) - 1
    often = np.bincount(group, weights=times[owner[order]], minlength=1) > 1
    flags = np.zeros(len(t), bool)
    flags[order] = often[group]
    lo, hi = zip(*[covered(flags[a : a + n - width + 1], width) for a, n in zip(at, lengths, strict=True)], strict=True) if contexts else ((), ())
    return list(lo), list(hi)


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of each k bytes."""
    cur = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    cur ^= cur >> np.uint64(31)
    base, out, off, powers, n = 0x2545F4914F6CDD1D, None, 0, [(1, cur)], len(b) - k + 1
    while powers[-1][0] * 2 <= k:
        size, x = powers[-1]
        powers.append((2 * size, x[:-size] * np.uint64(pow(base, size, 1 << 64)) + x[size:]))
    for size, x in reversed(powers):
        if off + size <= k:
            part = x[off : off + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            off += size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    p = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    p[: len(h)] = h
    p = p.reshape(-1, w)
    before, after = np.minimum.accumulate(p, 1).ravel(), np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: len(h) - w + 1], before[w - 1 : len(h)])


#: A longer text is worked through in pieces of so many windows.
PIECE = 1 << 20
LOW = np.uint64((1 << 24) - 1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Texts are laid end to end and worked on together; windows across an end are left out."""
    out = []
    pieces = [(k, off, text[off : off + PIECE + WIDTH - 1]) for k, text in enumerate(texts) for off in range(0, max(1, len(text) - WIDTH + 1), PIECE) if len(text) >= WIDTH]
    while pieces:
        group, held = [], 0
        while pieces and held < PIECE:
            group.append(pieces.pop())
            held += len(group[-1][2])
        data = b"".join(x[2] for x in group)
        grams = _grams(np.frombuffer(data, np.uint8), GRAM)
        # the leftmost of the least: its place stands in the low bits
        least = _least(grams & ~LOW | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1)
        place = (least & LOW).astype(np.int64)
        value = grams[place]
        lengths = np.array([len(x[2]) for x in group])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(group)), lengths)[: len(least)]
        ok = np.arange(len(least)) <= (ends - WIDTH)[owner]
        at, n = contexts(value, place, owner, ok, CONTEXT_WINDOWS)
        who = owner[at]
        context = np.array([digest(data[a : a + c + WIDTH - 1]) for a, c in zip(at.tolist(), n.tolist(), strict=True)], np.int64)
        number, shift = np.array([x[0] for x in group]), np.array([x[1] for x in group]) - (ends - lengths)
        out.append((number[who], at + shift[who], n, value[at].view(np.int64), context))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def cut(text: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    return [text[a : a + n + WIDTH - 1] for a, n in places]


def windows(data: bytes) -> list[tuple[int, int]]:
    return [digest2(data[i : i + WIDTH]) for i in range(len(data) - WIDTH + 1)]


#: 4096 contexts of one anchor are about 1.5 MB.
METHOD = Method(WIDTH, 4096, 2_000_000, 1 << 21, anchors, cut, judge, windows)


def dedup_bytes(docs: DataFrame, method: Method = METHOD, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary): a row per input row.

    Null texts are empty; texts under 200 bytes lose nothing, as do empty tables. Rows that repeat a document repeat its
    strings, so their bytes go in both. Only doc_id and text are read.
    """

    def row(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        edges = [0, *[x for s in spans for x in s], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * text)

    return finished(docs, method, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text)
