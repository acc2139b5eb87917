"""LM scoring with a log-frequency Bloom filter.

Unigram and bigram counts of the training rows are quantised on a log scale
(level ``j`` stands for counts from ``base^(j-1)`` up to ``base^j``), and a
key of level ``L`` enters the filter once per level 1..L.  A reader probes
level 1, 2, ... until a probe fails; the last hit gives the quantised count.

Probability of a token ``v`` after ``u`` (row start and row end are one
symbol)::

    p(v|u) = (c(u,v) + m * p0(v)) / (D(u) + m),  p0(v) = (c(v) + 1) / (D + V + 1)

with the filter's counts ``c``, and ``D(u)``, ``D`` their sums over the pairs
of u and over the words, as the filter gives them back: a distribution over
the vocabulary and one unknown word, but for false positives.  ``m = mu +
share * D(u)`` leaves unseen followers of a frequent word their part.  A false
positive on level 1 gives an unseen pair a count, and every word has about V
unseen followers; so level 1 takes as many probes as keep the sum over all of
them below ``TOLERANCE`` of u's denominator, which is more for rare words than
for frequent ones (further levels: ``hashes``), and pairs with an unknown word
are not probed.  A key sets, and a probe reads, ``BITS`` bits of one 64-bit
word.  ``score`` is the
sum of log10 p over the words of a text and its end.  The base score uses
exact unigram counts, kept beside the filter with ``D(u)``.

Jobs: (1) words are counted: every task pre-aggregates, deals by hash into
buckets, and one group a bucket merges and builds its part of the filter;
(2) so are pairs, dealt by their first word, but by both words where the
first one is hot (more tokens than a bucket has on average; there are fewer
of these than buckets), so no word is one group, and D(u) is summed where
the pairs are; (3) texts are scored by probes in one pass.

The parts are broadcast as files of the shared folder, so they never pass
through the driver's memory: where the folder is a mounted one the tasks open
them there, else (HDFS, object stores) they are announced with ``addFile`` and
every executor fetches its copies from the store.  A task reads one file after
another for each chunk of text and never holds two (a model of at most
``max_held`` bytes is read once).  The model takes about 5 bytes a distinct
pair and 20 a distinct word.

Nulls, empty texts: only the end token is scored.  Repeated rows are scored
alike; each counts for training.  An empty table gives an empty result, an
empty training set N = V = 0.  Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.llm.common import text_col
from evoclust.session import cut

U64 = np.uint64
END = U64(0x5BD1E995A7B3C1D9)  # row start and end
FLUSH = 1_000_000              # tokens gathered before a pre-aggregation
TOLERANCE = 0.003              # of a distribution that false positives may take
TOP = 400                      # levels
BITS = 4                       # of a word that a probe reads
WORD_PROBES = 2                # on level 1 of a single word's count
PROBE_BITS = 3.6               # one key in 2 ** this passes a probe: words are not filled evenly
LOW = U64(0xFFFFFFFF)


def _sequence(buf, offsets):
    """Token hashes with one END a row, their rows, and the previous token."""
    n = len(offsets) - 1
    s, e, row = tk.spans(buf, offsets)
    h = tk.span_hash(buf, s, e)
    tok = np.empty(len(h) + n, U64)
    at = np.arange(len(h)) + row
    tok[at] = h
    ends = np.cumsum(np.bincount(row, minlength=n)[:n]) + np.arange(n)
    tok[ends] = END
    rows = np.empty(len(tok), np.int64)
    rows[at], rows[ends] = row, np.arange(n)
    prev = np.empty_like(tok)
    prev[:1] = END
    prev[1:] = tok[:-1]
    return tok, prev, rows


def _bucket(key: np.ndarray, nb: int) -> np.ndarray:
    return ((key >> U64(32)) % U64(nb)).astype(np.int64)


def _member(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``some``."""
    if len(some) == 0:
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _pair_bucket(first: np.ndarray, pair: np.ndarray, hot: np.ndarray, nb: int) -> np.ndarray:
    return np.where(_member(first, hot), _bucket(pair, nb), _bucket(first, nb))


def _merge(keys: np.ndarray, counts: np.ndarray):
    """Different keys in order, the first place and the summed count of each."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1])))
    return k[at], order[at], np.add.reduceat(c, at) if len(at) else c


def _blobs(bucket: np.ndarray, nb: int, columns: list[tuple[np.ndarray, type]]) -> list[list]:
    """Bucket numbers, and the bytes of each column's part, for sorted buckets."""
    cuts = np.searchsorted(bucket, np.arange(nb + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return [some.tolist(), *([v[cuts[b]:cuts[b + 1]].astype(kind).tobytes() for b in some] for v, kind in columns)]


def _batch(columns: list, names: str) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * (len(columns) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def _word_counter(nb: int):
    """mapInArrow: texts to pre-aggregated (bucket, keys, counts) blobs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            b = _bucket(k, nb)
            order = np.argsort(b, kind="stable")
            return _batch(_blobs(b[order], nb, [(k[order], U64), (c[order], np.uint32)]), "b k c")

        for rb in batches:
            for _, _, buf, off in tk.chunks(rb.column("text")):
                held.append(_sequence(buf, off)[0])
                size += len(held[-1])
                if size >= 2 * FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    return run


def _pair_counter(nb: int, hot: np.ndarray):
    """mapInArrow: texts to blobs of (bucket; first words and how many pairs
    each has; pair keys; counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            first, pair = (np.concatenate(x) for x in zip(*held))
            k, at, c = _merge(pair, np.ones(len(pair), np.int64))
            u = first[at]
            b = _pair_bucket(u, k, hot, nb)
            order = np.lexsort((u, b))
            b, u, k, c = b[order], u[order], k[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (b[1:] != b[:-1]))))
            words = _blobs(b[new], nb, [(u[new], U64), (np.diff(np.append(new, len(u))), np.uint32)])
            return _batch([*words, *_blobs(b, nb, [(k, U64), (c, np.uint32)])[1:]], "b u n k c")

        for rb in batches:
            for _, _, buf, off in tk.chunks(rb.column("text")):
                tok, prev, _ = _sequence(buf, off)
                held.append((prev, tk.pair_hash(prev, tok)))
                size += len(tok)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    return run


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """Level of counts >= 1."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def level_values(base: float) -> np.ndarray:
    """Count that a level stands for: the mean of the whole numbers it
    covers (of its bounds, where it covers many)."""
    out = np.zeros(TOP + 1)
    for j in range(1, TOP + 1):
        lo, hi = math.ceil(base ** (j - 1) - 1e-9), math.ceil(base ** j - 1e-9) - 1
        out[j] = (lo + hi) / 2 if hi >= lo else base ** (j - 1)
    return out


def _bit_sets() -> np.ndarray:
    """4096 different choices of ``BITS`` of 64 bits, the same everywhere."""
    order = np.random.Generator(np.random.PCG64(6)).random((4096, 64)).argsort(1)
    return np.sort(order[:, :BITS], 1)


SETS = _bit_sets()
MASKS = (U64(1) << SETS.astype(U64)).sum(1, dtype=U64)


class Probes:
    """Where a level's bits of a key are, probe after probe: a word of the
    filter, and which of 4096 sets of its 64 bits."""

    def __init__(self, key: np.ndarray, lev: int, words):
        with np.errstate(over="ignore"):
            a = tk.mix(key + U64(lev) * U64(0xD1B54A32D192ED03))
            self.b = tk.mix(a + U64(0x2545F4914F6CDD1D))
        self.at, self.step, self.words = a >> U64(32), a & LOW | U64(1), words

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.at * self.words >> U64(32), self.b & U64(4095)
        self.at = self.at + self.step & LOW
        self.b = self.b >> U64(12)  # five times 12 bits, then they come again
        self.b |= (out[1] ^ self.step & U64(4095)) << U64(52)
        return out

    def keep(self, rows: np.ndarray) -> None:
        self.at, self.step, self.b = self.at[rows], self.step[rows], self.b[rows]
        if np.ndim(self.words):
            self.words = self.words[rows]


def probes_for(n: np.ndarray, n_types: int, mu: float, share: float) -> np.ndarray:
    """Probes on level 1 for the pairs of words with ``n`` tokens: what keeps
    false positives among ``n_types`` followers small in their denominator."""
    allowed = TOLERANCE * (mu + (1 + share) * np.asarray(n, float)) / max(n_types, 1)
    return np.maximum(1, np.ceil(-np.log2(np.minimum(allowed, 0.5)) / PROBE_BITS)).astype(np.int64)


def build_filter(keys: np.ndarray, counts: np.ndarray, base: float, first: np.ndarray, hashes: int) -> np.ndarray:
    """Words of one bucket's filter, about half of its bits set: ``first``
    probes for each key on level 1, ``hashes`` on the others."""
    lev = level(counts, base)
    top = int(lev.max()) if len(lev) else 0
    if top > TOP:
        raise ValueError(f"a count of {counts.max()} is beyond level {TOP} of base {base}: take a larger base")
    words = max(1, math.ceil(BITS * (int(first.sum()) + int((lev - 1).sum()) * hashes) / math.log(2) / 64.0))
    if words >= 1 << 32:
        raise ValueError("a bucket's filter has 2^32 words or more: take smaller buckets")
    bits = np.zeros(words * 64, bool)
    for j in range(1, top + 1):
        some = lev >= j
        probes, times = Probes(keys[some], j, U64(words)), first if j == 1 else np.full(int(some.sum()), hashes)
        for i in range(int(times.max(initial=0))):
            at, which = (x[times > i] for x in probes.next())
            at = (at << U64(6)).astype(np.int64)
            for k in range(BITS):
                bits[at + SETS[which, k]] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def _columns(t: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)]) for name, kind in kinds.items()]


def _table(b: int, **values) -> pa.Table:
    kinds = {int: pa.int64(), float: pa.float64(), bytes: pa.binary()}
    return pa.table({"b": pa.array([b], pa.int32()), **{k: pa.array([v], kinds[type(v)]) for k, v in values.items()}})


def _word_builder(nb: int, base: float, hashes: int):
    def run(t: pa.Table) -> pa.Table:
        k, c = _columns(t, k=U64, c=np.uint32)
        k, _, c = _merge(k, c.astype(np.int64))
        two = np.full(len(k), WORD_PROBES)
        f, b = build_filter(k, c, base, two, hashes), t.column("b")[0].as_py()
        back = Bits([(b, f.tobytes())], nb, hashes, base).counts(k, np.full(len(k), b), two)
        return _table(b, n_tokens=int(c.sum()), n_types=len(k), total=float(back.sum()), size=16 * len(k) + f.nbytes,
                      k=k.tobytes(), c=c.tobytes(), f=f.tobytes())
    return run


def _pair_builder(nb: int, hot: np.ndarray, hot_n: np.ndarray, base: float, probes, hashes: int):
    """``probes`` of a word's tokens: of a hot word all over the table, of
    another one in its bucket."""
    def run(t: pa.Table) -> pa.Table:
        u, n, k, c = _columns(t, u=U64, n=np.uint32, k=U64, c=np.uint32)
        u = np.repeat(u, n)
        k, at, c = _merge(k, c.astype(np.int64))
        u = u[at]
        every, at = np.unique(u, return_inverse=True)
        n = np.bincount(at, c, len(every))
        h = _member(every, hot)
        n[h] = hot_n[np.searchsorted(hot, every[h])]
        first = probes(n)[at]
        f, b = build_filter(k, c, base, first, hashes), t.column("b")[0].as_py()
        back = Bits([(b, f.tobytes())], nb, hashes, base).counts(k, np.full(len(k), b), first)
        u, _, d = _merge(u, back)
        return _table(b, size=f.nbytes, f=f.tobytes(), u=u[~h].tobytes(), d=d[~h].tobytes(), hu=u[h].tobytes(), hd=d[h].tobytes())
    return run


_WORDS = "b int, n_tokens long, n_types long, total double, size long, k binary, c binary, f binary"
_PAIRS = "b int, size long, f binary, u binary, d binary, hu binary, hd binary"


class Trained:
    """The filter's parts, one row a bucket, in the shared folder, and the
    numbers that all of them share."""

    def __init__(self, texts: DataFrame, mu: float, share: float, base: float, hashes: int, bucket_bytes: int):
        self.mu, self.share, self.base, self.hashes = mu, share, base, hashes
        texts = texts.select(text_col().alias("text"))
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        nb = self.nb = max(64, -(-size // bucket_bytes))
        self.words = cut(texts.mapInArrow(_word_counter(nb), "b int, k binary, c binary").groupBy("b")
                         .applyInArrow(_word_builder(nb, base, hashes), _WORDS), "lm-words")
        n, v, d = self.words.agg(F.sum("n_tokens"), F.sum("n_types"), F.sum("total")).first()
        self.n_tokens, self.n_types, self.total = n or 0, v or 0, d or 0.0
        self.hot, hot_n = self._hot(self.n_tokens / nb)
        probes = self.probes = functools.partial(probes_for, n_types=self.n_types, mu=mu, share=share)
        pairs = texts.mapInArrow(_pair_counter(nb, self.hot), "b int, u binary, n binary, k binary, c binary")
        self.pairs = cut(pairs.groupBy("b").applyInArrow(_pair_builder(nb, self.hot, hot_n, base, probes, hashes), _PAIRS), "lm-pairs")

    def _hot(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Words with more than ``least`` tokens, of which there are fewer
        than buckets, and their tokens."""
        def run(batches):
            for rb in batches:
                for k, c in zip(rb.column("k"), rb.column("c")):
                    k, c = np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k[c > least]), pa.array(c[c > least])], names=["u", "n"])
        got = self.words.select("k", "c").mapInArrow(run, "u long, n long").toArrow()
        u = got["u"].to_numpy().view(U64) if got.num_rows else np.zeros(0, U64)
        return np.sort(u), got["n"].to_numpy()[np.argsort(u)] if got.num_rows else np.zeros(0, np.int64)

    def hot_totals(self) -> np.ndarray:
        def run(batches):
            for rb in batches:
                for u, d in zip(rb.column("hu"), rb.column("hd")):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(u.as_py(), np.int64)),
                                                      pa.array(np.frombuffer(d.as_py(), float))], names=["u", "d"])
        got = self.pairs.select("hu", "hd").mapInArrow(run, "u long, d double").groupBy("u").agg(F.sum("d").alias("d")).toArrow()
        out = np.zeros(len(self.hot))
        if got.num_rows:
            out[np.searchsorted(self.hot, got["u"].to_numpy().view(U64))] = got["d"].to_numpy()
        return out

    def scorer(self, max_held: int = 64 << 20) -> Scorer:
        """Where the workers find the filter's files."""
        sc = self.words.sparkSession.sparkContext
        size = sum(df.agg(F.sum("size")).first()[0] or 0 for df in (self.words, self.pairs))
        files = []
        for df in (self.words, self.pairs):
            files.append([])
            for uri in sorted(df.inputFiles()):
                where = urlparse(uri)
                if where.scheme not in ("", "file"):
                    sc.addFile(uri)
                files[-1].append(unquote(where.path) if where.scheme in ("", "file") else os.path.basename(where.path))
        return Scorer(self.n_tokens, self.n_types, self.total, self.hot, self.hot_totals(), self.probes, self.mu, self.share,
                      Files(*files, self.nb, self.hashes, self.base, size <= max_held))


class Words(NamedTuple):
    """A file's words: sorted keys, exact counts, filter."""

    keys: np.ndarray
    n: np.ndarray
    bits: Bits


class Pairs(NamedTuple):
    """A file's pairs: sorted first words, the totals of their pairs, filter."""

    keys: np.ndarray
    totals: np.ndarray
    bits: Bits


class Files:
    """The filter's files on a worker, read one after another."""

    def __init__(self, words: list[str], pairs: list[str], nb: int, hashes: int, base: float, hold: bool):
        self.names, self.nb, self.hashes, self.base, self.hold, self.held = {"w": words, "p": pairs}, nb, hashes, base, hold, {}

    def _read(self, kind: str) -> Iterator:
        key, value, dtype = ("k", "c", np.int64) if kind == "w" else ("u", "d", float)
        for name in self.names[kind]:
            path = name if os.path.isabs(name) else SparkFiles.get(name)
            t = pq.ParquetFile(path).read(columns=["b", key, value, "f"])
            col = lambda c, d: np.concatenate([np.frombuffer(x.as_buffer(), d) for x in t.column(c)] or [np.zeros(0, d)])  # noqa: E731, B023
            k, v = col(key, U64), col(value, dtype)
            order = np.argsort(k)
            bits = Bits([(b.as_py(), f.as_buffer()) for b, f in zip(t.column("b"), t.column("f"))], self.nb, self.hashes, self.base)
            yield (Words if kind == "w" else Pairs)(k[order], v[order], bits)

    def _each(self, kind: str) -> Iterator:
        if not self.hold:
            return self._read(kind)
        if kind not in self.held:
            self.held[kind] = list(self._read(kind))
        return iter(self.held[kind])

    def words(self) -> Iterator[Words]:
        return self._each("w")

    def pairs(self) -> Iterator[Pairs]:
        return self._each("p")


class Bits:
    """A segment's filters side by side: words, and the first word and number
    of words of every bucket; buckets outside the segment have none."""

    def __init__(self, parts: list[tuple[int, bytes]], nb: int, hashes: int, base: float):
        self.start, self.m = np.zeros(nb, U64), np.zeros(nb, U64)
        self.hashes, self.values, self.nb = hashes, level_values(base), nb
        at = 0
        for b, f in parts:
            self.start[b], self.m[b] = at, len(f) // 8
            at += len(f) // 8
        self.words = np.frombuffer(b"".join(memoryview(f) for _, f in parts), U64)

    def counts(self, key: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Quantised counts by membership probes, level after level, ``first``
        of them on level 1; 0 in buckets of another segment."""
        lev = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.m[bucket] > 0)
        for j in range(1, TOP + 1):
            b = bucket[live]
            probes, start = Probes(key[live], j, self.m[b]), self.start[b]
            times = first[live] if j == 1 else None
            for i in range(self.hashes if times is None else int(times.max(initial=0))):
                at, which = probes.next()
                mask = MASKS[which]
                hit = self.words[at + start] & mask == mask
                if times is not None:
                    hit |= times <= i
                if not hit.all():
                    live, start = live[hit], start[hit]
                    times = None if times is None else times[hit]
                    probes.keep(hit)
            if not len(live):
                break
            lev[live] = j
        return self.values[lev]


class Scorer:
    """Scores texts from the filter's files."""

    def __init__(self, n_tokens: int, n_types: int, total: float, hot: np.ndarray, hot_totals: np.ndarray, probes, mu: float,
                 share: float, files: Files):
        self.n_tokens, self.n_types, self.total, self.hot, self.hot_totals = n_tokens, n_types, total, hot, hot_totals
        self.probes, self.mu, self.share, self.files = probes, mu, share, files

    def words(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact count and filter's count of each word."""
        n, c, bucket = np.zeros(len(kinds), np.int64), np.zeros(len(kinds)), None
        for w in self.files.words():
            here = np.flatnonzero(_member(kinds, w.keys))
            n[here] = w.n[np.searchsorted(w.keys, kinds[here])]
            bucket = _bucket(kinds, w.bits.nb) if bucket is None else bucket
            c[here] = w.bits.counts(kinds[here], bucket[here], np.full(len(here), WORD_PROBES))
        return n, c

    def probabilities(self, kinds, n, c, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """p(v|u) for places ``u, v`` in ``kinds``; ``n, c`` from ``words``."""
        both = np.flatnonzero((n[u] > 0) & (n[v] > 0))
        pairs, inv = np.unique(u[both] * len(kinds) + v[both], return_inverse=True)
        at = pairs // max(len(kinds), 1)
        first, times = kinds[at], self.probes(n)[at]
        key = tk.pair_hash(first, kinds[pairs % max(len(kinds), 1)])
        got, d, bucket = np.zeros(len(pairs)), np.zeros(len(kinds)), None
        for p in self.files.pairs():
            bucket = _pair_bucket(first, key, self.hot, p.bits.nb) if bucket is None else bucket
            got += p.bits.counts(key, bucket, times)
            here = np.flatnonzero(_member(kinds, p.keys))
            d[here] = p.totals[np.searchsorted(p.keys, kinds[here])]
        hot = np.flatnonzero(_member(kinds, self.hot))
        d[hot] = self.hot_totals[np.searchsorted(self.hot, kinds[hot])]
        seen = np.zeros(len(u))
        seen[both] = got[inv]
        m = self.mu + self.share * d[u]
        return (seen + m * (c[v] + 1.0) / (self.total + self.n_types + 1.0)) / (d[u] + m)

    def score(self, buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        rows = len(off) - 1
        tok, _, row = _sequence(buf, off)
        kinds, v = np.unique(tok, return_inverse=True)
        u = np.concatenate((np.searchsorted(kinds, [END]), v[:-1]))
        n, c = self.words(kinds)
        p = self.probabilities(kinds, n, c, u, v)
        base = np.log10((n + 1.0) / (self.n_tokens + self.n_types + 1.0))
        add = lambda w=None: np.bincount(row, w, minlength=rows)[:rows]
        return {"n_tokens": add(), "n_known": add(n[v] > 0).astype(np.int64), "base_score": add(base[v]), "score": add(np.log10(p))}


def _score(scorer: Scorer):
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # files that are read again for each chunk ask for larger ones
        limit = 2 << 20 if scorer.files.hold else 8 << 20
        for col in it:
            out = {k: np.zeros(len(col), float if "score" in k else np.int64) for k in ("n_tokens", "n_known", "base_score", "score")}
            for lo, hi, buf, off in tk.chunks(col, limit):
                for k, x in scorer.score(buf, off).items():
                    out[k][lo:hi] = x
            yield pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))
    return F.arrow_udf(run, "n_tokens long, n_known long, base_score double, score double")


def train(texts: DataFrame, mu: float = 4.0, share: float = 1.0, base: float = 1.5, hashes: int = 2,
          bucket_bytes: int = 8 << 20) -> Trained:
    """Learns from all rows; a bucket for ``bucket_bytes`` of text."""
    return Trained(texts, mu, share, base, hashes, bucket_bytes)


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", max_held: int = 64 << 20, **params) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for every row of ``docs``; the rows where ``train_on`` holds
    train the model."""
    model = train(docs.filter(train_on), **params)
    got = docs.select(F.col(id_col), train_on.alias("__train"), _score(model.scorer(max_held))(text_col()).alias("__s"))
    return got.select(F.col(id_col), (~F.col("__train")).alias("held_out"), "__s.n_tokens", "__s.n_known",
                      F.lit(model.n_tokens).cast("long").alias("train_tokens"), "__s.base_score", "__s.score")
