"""Vectorised text helpers that run inside Arrow batches.

A batch's string column is read as one byte buffer with row offsets, so
words are found and hashed for all rows at once, without a Python object
per word.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.

The hash of a span is ``sum(T[b[i]] * P^i) mod 2^64`` over a table ``T`` of
random 64-bit values (a prefix sum gives every span of a buffer in one
pass), then mixed.  It is a 64-bit fingerprint: two different words share
it with a chance of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 4 << 20  # text handled at once inside a batch
PIECE = 1 << 20        # bytes hashed at once
_P = 0x9E3779B97F4A7C15
_IP = pow(_P, -1, 1 << 64)

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_T = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_T_FOLD = _T.copy()
_T_FOLD[65:91] = _T_FOLD[97:123]  # A-Z as a-z

_pw = np.ones(1, U64)
_ipw = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            a = np.full(size, U64(_P))
            a[0] = 1
            b = np.full(size, U64(_IP))
            b[0] = 1
            _pw, _ipw = np.cumprod(a), np.cumprod(b)
    return _pw, _ipw


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-aware hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xC2B2AE3D27D4EB4F) + b)


def chunks(col, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, bytes, offsets)`` for runs of rows of at most ``max_bytes``
    (a longer row comes alone); nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SEP):
    """Starts, ends and row numbers of the maximal runs without separators;
    runs never cross rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = sep[buf]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, s, "right") - 1
    return s, e, row


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the (ordered, disjoint) spans ``[s, e)``; ``fold``
    reads A-Z as a-z."""
    out = np.empty(len(s), U64)
    table = _T_FOLD if fold else _T
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(s):
            hi = max(int(np.searchsorted(e, s[lo] + PIECE, "right")), lo + 1)
            a, b = int(s[lo]), int(e[hi - 1])
            pw, ipw = _powers(b - a + 1)
            cs = np.empty(b - a + 1, U64)
            cs[0] = 0
            np.cumsum(table[buf[a:b]] * pw[:b - a], out=cs[1:])
            sa, ea = s[lo:hi] - a, e[lo:hi] - a
            out[lo:hi] = mix((cs[ea] - cs[sa]) * ipw[sa] + (ea - sa).astype(U64))
            lo = hi
    return out


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: the sum of a per-byte array."""
    cs = np.empty(len(mask) + 1, np.int64)
    cs[0] = 0
    np.cumsum(mask, out=cs[1:])
    return cs[offsets[1:]] - cs[offsets[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """Flag of every element whose value occurs more than once."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


# ------------------------------------------------- structure statistics

_CLASS = np.zeros(256, np.uint8)  # 0: other
SYMBOLS = b"#*$%&|<>"
for _b in SYMBOLS:
    _CLASS[_b] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _b in b".,;:?":
    _CLASS[_b] = 4
_CLASS[ord("!")] = 5
_CLASS[97:123] = 6

STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_chars", "n_upper", "n_digits", "n_punct", "n_bang", "n_lines", "n_long_words", "n_new_words")


def text_stats(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts per row, whole text (see ``STAT_NAMES``): words, code
    points in words, ``[#*$%&|<>]``, lines with a word equal to an earlier
    line, words in 3-word windows found twice or more, code points, A-Z,
    0-9, ``.,;:?``, ``!``, lines with a word, words over 20 bytes, distinct
    words."""
    n = len(offsets) - 1
    s, e, row = spans(buf, offsets)
    h = span_hash(buf, s, e, fold=False)
    per = lambda r, w=None: np.bincount(r, w, minlength=n)[:n].astype(np.int64)
    out = {"n_words": per(row)}
    lead = (buf & 0xC0) != 0x80  # first byte of a code point
    out["n_chars"] = row_sums(lead, offsets)
    out["word_chars"] = row_sums(lead & ~SEP[buf], offsets)
    kind = _CLASS[buf]
    for name, k in (("n_symbols", 1), ("n_upper", 2), ("n_digits", 3), ("n_punct", 4), ("n_bang", 5)):
        out[name] = row_sums(kind == k, offsets)
    # lines
    ls, le, lrow = spans(buf, offsets, NEWLINE)
    has = np.searchsorted(s, le, "left") > np.searchsorted(s, ls, "left")
    ls, le, lrow = ls[has], le[has], lrow[has]
    out["n_lines"] = per(lrow)
    out["n_dup_lines"] = out["n_lines"] - _distinct(span_hash(buf, ls, le, fold=False), lrow, n)
    # words and 3-word windows
    out["n_new_words"] = _distinct(h, row, n)
    out["n_long_words"] = per(row[(e - s) > 20])
    cover = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])
        g = pair_hash(pair_hash(h[at], h[at + 1]), pair_hash(h[at + 2], row[at].astype(U64)))
        hit = at[repeated(g)]
        for k in range(3):
            cover[hit + k] = True
    out["n_repeat_words"] = per(row[cover])
    return out


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if len(h) == 0:
        return np.zeros(n, np.int64)
    key = pair_hash(h, row.astype(U64))
    _, at = np.unique(key, return_index=True)
    return np.bincount(row[at], minlength=n)[:n].astype(np.int64)


def ratios(st: dict[str, np.ndarray]) -> np.ndarray:
    """Float features of ``text_stats`` (rows x len(RATIO_NAMES))."""
    w = np.maximum(st["n_words"], 1).astype(float)
    c = np.maximum(st["n_chars"], 1).astype(float)
    ln = np.maximum(st["n_lines"], 1).astype(float)
    cols = [np.log1p(st["n_words"]), st["word_chars"] / w, st["n_symbols"] / w, st["n_dup_lines"] / ln,
            st["n_repeat_words"] / w, st["n_upper"] / c, st["n_digits"] / c, st["n_punct"] / w,
            st["n_bang"] / w, st["n_words"] / ln, st["n_long_words"] / w, st["n_new_words"] / w]
    return np.stack(cols, 1)


RATIO_NAMES = ("log_words", "word_len", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
               "digit_share", "punct_per_word", "bang_per_word", "words_per_line", "long_word_share", "distinct_share")
