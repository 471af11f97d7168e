"""Hashed five-word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from skein.llm.suffix import Slice, mix

SIZE = 5
_STEP = 1 << 19
_CHUNK = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, begins: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word; documents begin at ``begins``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    head = np.zeros(len(data), bool)
    head[begins[begins < len(data)]] = True
    joined = head & inside
    joined[1:] &= inside[:-1]
    joined[0] = False
    # a document that begins right after another one's last word begins a word of its own
    starts = np.flatnonzero((edge[:-1] & inside) | joined)
    stop = edge[1:] & inside
    stop[:-1] |= joined[1:]
    ends = np.flatnonzero(stop) + 1
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + _STEP)))
        a, b = starts[at], ends[upto - 1]
        s = Slice(_LOWER[data[a:b]] if lower else data[a:b])
        out[at:upto] = mix(s.stretch(starts[at:upto] - a, ends[at:upto] - a))
        at = upto
    return starts, ends, out


def chunks(texts):
    """Lists of (index, bytes) of about ``_CHUNK`` bytes, of under 60,000 texts."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        raw = (t.as_py() or "").encode()
        rows.append((i, raw))
        size += len(raw)
        if size >= _CHUNK or len(rows) >= 60_000:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def layout(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8)
    ends = np.cumsum([len(r) for _, r in rows], dtype=np.int64)
    return data, ends - np.array([len(r) for _, r in rows], np.int64), ends


def shingle_sets(rows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents in document order, and the border before each document."""
    data, begins, ends = layout(rows)
    starts, _, h = words(data, begins)
    first = np.searchsorted(starts, begins)
    count = np.searchsorted(starts, ends) - first
    made = np.maximum(0, count - SIZE + 1)
    made[(count > 0) & (count < SIZE)] = 1
    doc = np.repeat(np.arange(len(rows)), made)
    total = np.cumsum(made)
    at = np.arange(len(doc)) - np.repeat(total - made, made) + first[doc] if len(doc) else np.zeros(0, np.int64)
    left = np.minimum(count[doc], SIZE)
    out = left.astype(np.uint64)
    for k in range(SIZE):
        use = left > k
        out[use] = mix(out[use] * np.uint64(5) + h[at[use] + k])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(rows) + 1))
