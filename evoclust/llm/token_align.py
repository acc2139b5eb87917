"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Both token sequences of a text cover the same bytes, so each is a rising
list of end offsets, and aligning them is a merge of two sorted lists.
:func:`lockstep` merges those of all documents of a chunk at once: a NumPy
state vector holds one A pointer and one B pointer a lane, every step moves
the pointer (or both) with the smaller end, equal ends emit a cut and a link,
finished lanes are compacted away.  A lane is a stretch of at most
``lane_bytes`` bytes of one document; a long document is several lanes (the
start pointers of a lane are found by binary search), so the number of steps
does not follow the longest text.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library, B a
SentencePiece model.  The driver reads the two files from the paths given and
broadcasts their bytes (fixed size, a few MB at most).

Link counts: every document's distinct links are written once to the shared
folder, summed with map-side combine, and looked up in sorted arrays that are
broadcast in key ranges of at most ``max_broadcast`` bytes.  There are at most
``|A| * |B|`` id pairs however large the corpus, hence a bounded number of
ranges; results are the same for any number.

Defined results: null or empty texts, and texts whose joined token bytes of A
or B are not a space and the text (characters that a tokenizer changes), have
no tokens: zeros, no groups, digest ''.  Repeated and null ids are rows like
any other.  Extra columns are not read.  Texts of any length are aligned
whole; an Arrow batch is cut into chunks of ``CHUNK`` bytes of text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.llm.common import numbered, ROW
from evoclust.session import cut

CHUNK = 1 << 20        # bytes of text tokenized and merged at once
LANE_BYTES = 512
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


# ------------------------------------------------------------ vocabularies

def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level encoding: printable Latin-1
    characters stand for themselves, the other bytes for 256 and up."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{chr(b): b for b in keep}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file through Spark's readers, so that any store works."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


class Pair:
    """The two tokenizers of a task, and the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec = json.loads(a_json)
        alphabet = byte_level_alphabet()
        names = {i: w for w, i in spec["model"]["vocab"].items()}
        names.update({t["id"]: None for t in spec.get("added_tokens", [])})
        self.a_bytes = [bytes(alphabet[c] for c in names[i]) if names.get(i) is not None else b""
                        for i in range(max(names) + 1)]
        hexed = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            p = self.b.id_to_piece(i)
            m = hexed.fullmatch(p) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode("utf-8"))
        self.a_table, self.b_table = _table(self.a_bytes), _table(self.b_bytes)

    def encode(self, texts: list[str]) -> tuple[Flat, Flat]:
        """Ids of both for all texts; none for a text where the joined bytes
        of either are not a space and the text."""
        spaced = [" " + t for t in texts]
        a = Flat([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        b = Flat(self.b.encode(texts, num_threads=1))
        want = [t.encode("utf-8", "replace") for t in spaced]
        size = np.array([len(w) for w in want], np.int64)
        text = np.frombuffer(b"".join(want), np.uint8)
        ok = a.spells(text, size, self.a_table) & b.spells(text, size, self.b_table) & (size > 1)
        return a.only(ok), b.only(ok)


class Flat:
    """Token ids of several texts in one array."""

    def __init__(self, lists: list[list[int]]):
        self.n = np.array([len(x) for x in lists], np.int64)
        self.ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(self.n.sum()))

    def spells(self, text: np.ndarray, size: np.ndarray, table) -> np.ndarray:
        """Which texts (``size`` bytes each, one after another) the tokens'
        bytes make up."""
        start, length, flat = table
        cum = np.concatenate([[0], np.cumsum(length[self.ids])])
        at = np.concatenate([[0], np.cumsum(self.n)])
        ok = cum[at[1:]] - cum[at[:-1]] == size
        ids = self.ids[np.repeat(ok, self.n)]
        n = length[ids]
        got = flat[np.arange(n.sum()) + np.repeat(start[ids] - np.cumsum(n) + n, n)]
        same = got == text[np.repeat(ok, size)]
        ends = np.concatenate([[0], np.cumsum(size[ok])])
        ok[ok] = np.diff(np.concatenate([[0], np.cumsum(~same)])[ends]) == 0
        return ok

    def only(self, ok: np.ndarray) -> Flat:
        self.ids, self.n = self.ids[np.repeat(ok, self.n)], np.where(ok, self.n, 0)
        return self


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and all bytes of the tokens, one after another."""
    n = np.array([len(x) for x in tokens], np.int64)
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(tokens), np.uint8)


# ------------------------------------------------------------------- merge

def lockstep(a_end: np.ndarray, b_end: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and of the B tokens that end together, in order.

    ``a_end``, ``b_end``: rising token ends; ``lanes``: rising bounds, of
    which each neighbouring pair is a lane ``(from, to]``."""
    if len(lanes) < 2:
        z = np.zeros(0, np.int64)
        return z, z
    at_a, at_b = np.searchsorted(a_end, lanes, "right"), np.searchsorted(b_end, lanes, "right")
    i, i_stop, j, j_stop = at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]
    got_a, got_b = [], []
    while True:
        live = (i < i_stop) & (j < j_stop)
        if not live.all():  # finished lanes leave the state vector
            i, i_stop, j, j_stop = i[live], i_stop[live], j[live], j_stop[live]
        if len(i) == 0:
            break
        d = a_end[i] - b_end[j]
        same = d == 0
        got_a.append(i[same])
        got_b.append(j[same])
        i, j = i + (d <= 0), j + (d >= 0)
    if not got_a:
        z = np.zeros(0, np.int64)
        return z, z
    return np.sort(np.concatenate(got_a)), np.sort(np.concatenate(got_b))


class Merged:
    """The alignment of a chunk of documents, all arrays flat."""

    def __init__(self, pair: Pair, texts: list[str], lane_bytes: int):
        a, b = pair.encode(texts)
        self.a, self.b, self.n_a, self.n_b = a.ids, b.ids, a.n, b.n
        a_end, b_end = np.cumsum(pair.a_table[1][a.ids]), np.cumsum(pair.b_table[1][b.ids])
        self.a_off = np.concatenate([[0], np.cumsum(self.n_a)])
        self.b_off = np.concatenate([[0], np.cumsum(self.n_b)])
        base = np.concatenate([[0], a_end])[self.a_off]  # byte range of each document in the chunk
        lanes = [np.arange(lo, hi, lane_bytes) for lo, hi in zip(base[:-1], base[1:]) if hi > lo]
        lanes = np.concatenate([*lanes, base[-1:]]) if lanes else np.zeros(0, np.int64)
        self.cut_a, self.cut_b = lockstep(a_end, b_end, lanes)
        self.cut_off = np.searchsorted(self.cut_a, self.a_off)  # cuts before each document
        self.n_groups = np.diff(self.cut_off)
        self.cut_byte = a_end[self.cut_a] - np.repeat(base[:-1], self.n_groups)

    def digests(self, digits: np.ndarray, n_ids_a: int) -> list[str]:
        """SHA-256 of every document's ``a1,a2|b1;a3|b2`` ('' without tokens);
        ``digits``: those of the ids of A, then of B."""
        na, nb = len(self.a), len(self.b)
        before = np.concatenate([[0], self.cut_b + 1])  # B tokens in the groups before each group
        after = self.cut_a + 1                          # A tokens up to the end of each group
        size_a = np.diff(self.cut_a, prepend=-1)
        size_b = np.diff(self.cut_b, prepend=-1)
        pos_a = np.arange(na) + np.repeat(before[:-1], size_a)
        pos_b = np.arange(nb) + np.repeat(after, size_b)
        row, sep = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
        row[pos_a], row[pos_b] = self.a, self.b + n_ids_a
        sep[pos_a[self.cut_a]] = ord("|")
        sep[pos_b[self.cut_b]] = ord(";")
        sep[pos_b[self.b_off[1:][self.n_b > 0] - 1]] = 0
        buf = digits.take(row, 0)
        buf[:, -1] = sep
        kept = buf != 0
        at = np.concatenate([[0], np.cumsum(np.count_nonzero(kept, 1))])[self.a_off + self.b_off]
        flat = memoryview(buf[kept])
        return [hashlib.sha256(flat[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:])]

    def pairs(self, n_ids_a: int, n_ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct links of each document: offsets, keys ``b * |A| + a``, times."""
        n_keys = n_ids_a * n_ids_b
        doc = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        key = np.sort(doc * n_keys + self.b[self.cut_b] * n_ids_a + self.a[self.cut_a])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(at, len(key)))
        doc, key = np.divmod(key[at], n_keys)
        return np.searchsorted(doc, np.arange(len(self.n_groups) + 1)), key, times


def digit_table(n_ids: int, width: int) -> np.ndarray:
    """Decimal digits of every id, left aligned, zero filled, and a column
    for a separator."""
    return np.array([str(i) for i in range(n_ids)], f"S{width + 1}").view(np.uint8).reshape(n_ids, width + 1)


def _chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > lo and size + n > limit:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _lists(off: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def _texts(col) -> list[str]:
    """Texts as Python strings; bytes that are no UTF-8 never match."""
    raw = col.cast(pa.binary()).to_pylist()
    return [(x or b"").decode("utf-8", "replace") for x in raw]


# --------------------------------------------------------------- operators

def _vocabularies(spark, a_path, b_path):
    return spark.sparkContext.broadcast((read_file(spark, a_path), read_file(spark, b_path)))


_PAIRS: dict = {}


def _pair(files) -> Pair:
    key = hashlib.sha1(files[0] + files[1]).digest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*files)
    return _PAIRS[key]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          lane_bytes: int = LANE_BYTES) -> DataFrame:
    """The alignment itself: ``id, a_ids, b_ids, cut_a, cut_b, cut_byte``, the
    last three one entry a group: how many A tokens, B tokens and bytes of
    space+text lie up to the group's end."""
    files = _vocabularies(docs.sparkSession, a_path, b_path)

    def run(batches):
        pair = _pair(files.value)
        for rb in batches:
            texts = _texts(rb.column(1))
            for lo, hi in _chunks(texts, CHUNK):
                m = Merged(pair, texts[lo:hi], lane_bytes)
                ints = pa.int32()
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(lo, hi - lo), _lists(m.a_off, m.a, ints), _lists(m.b_off, m.b, ints),
                     _lists(m.cut_off, m.cut_a + 1 - np.repeat(m.a_off[:-1], m.n_groups), ints),
                     _lists(m.cut_off, m.cut_b + 1 - np.repeat(m.b_off[:-1], m.n_groups), ints),
                     _lists(m.cut_off, m.cut_byte, pa.int64())],
                    names=[id_col, "a_ids", "b_ids", "cut_a", "cut_b", "cut_byte"])

    d = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, a_ids array<int>, b_ids array<int>, cut_a array<int>, "
                             "cut_b array<int>, cut_byte array<bigint>")


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          lane_bytes: int = LANE_BYTES) -> tuple[DataFrame, int]:
    """Per document: counts, the digest of its groups and its distinct links
    (``pairs``: key ``b * n + a``, ``times``); and that ``n``, the ids of A."""
    spark = docs.sparkSession
    files = _vocabularies(spark, a_path, b_path)
    spec = json.loads(files.value[0])
    n_ids = 1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec.get("added_tokens", [])), 0)

    def run(batches):
        pair = _pair(files.value)
        assert len(pair.a_bytes) == n_ids
        width = len(str(max(n_ids, len(pair.b_bytes)) - 1))
        digits = np.concatenate([digit_table(n_ids, width), digit_table(len(pair.b_bytes), width)])
        for rb in batches:
            texts = _texts(rb.column(1))
            for lo, hi in _chunks(texts, CHUNK):
                m = Merged(pair, texts[lo:hi], lane_bytes)
                off, key, times = m.pairs(n_ids, len(pair.b_bytes))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(lo, hi - lo), pa.array(m.n_a), pa.array(m.n_b), pa.array(m.n_groups),
                     pa.array(m.digests(digits, n_ids), pa.string()),
                     _lists(off, key, pa.int64()), _lists(off, times, pa.int32())],
                    names=[id_col, "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    d = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = d.schema[0].dataType.simpleString()
    got = d.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
                            "pairs array<bigint>, times array<int>")
    return got, n_ids


def link_counts(linked: DataFrame, n_ids: int) -> DataFrame:
    """``key, n, best``: links corpus-wide that hold the id pair, and whether
    no pair of the same B id has more."""
    one = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    n = one.groupBy(F.col("x.pairs").alias("key")).agg(F.sum("x.times").alias("n"))
    n = cut(n.withColumn("b", F.expr(f"key div {n_ids}")), "link-counts")
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return cut(n.join(top, "b").select("b", "key", "n", (F.col("n") == F.col("top")).alias("best")), "link-best")


def _ranges(counts: DataFrame, max_broadcast: int) -> list[tuple[int, int]]:
    """Ranges of B ids of at most ``max_broadcast`` bytes of counts each (a
    B id is never cut: its pairs are at most the ids of A)."""
    rows = sorted(counts.groupBy("b").count().collect())  # at most the ids of B
    out, lo, size = [], None, 0
    for b, n in rows:
        if lo is not None and size + n * 17 > max_broadcast:
            out.append((lo, last))
            lo, size = None, 0
        lo, last, size = (b if lo is None else lo), b, size + n * 17
    return out + ([(lo, last)] if lo is not None else [])


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            lane_bytes: int = LANE_BYTES, max_broadcast: int = 64 << 20) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    got, n_ids = links(docs, a_path, b_path, id_col, text_col, lane_bytes)
    linked = numbered(got, "links")
    counts = link_counts(linked, n_ids)

    def looked_up(lo: int, hi: int) -> DataFrame:
        t = counts.filter(F.col("b").between(lo, hi)).select("key", "n", "best").toArrow()
        order = np.argsort(t["key"].to_numpy())
        held = spark.sparkContext.broadcast((t["key"].to_numpy()[order], t["n"].to_numpy()[order],
                                             t["best"].to_numpy(zero_copy_only=False)[order]))

        def run(batches):
            key, n, best = held.value
            for rb in batches:
                c = rb.column(1)
                off = c.offsets.to_numpy()
                k = c.values.to_numpy()[off[0]:off[-1]]
                t = rb.column(2).values.to_numpy()[off[0]:off[-1]].astype(np.int64)
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                t = np.where(key[at] == k, t, 0)  # keys of another range
                sums = [np.concatenate([[0], np.cumsum(x)])[off - off[0]] for x in (t * best[at], t * n[at])]
                yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(np.diff(s)) for s in sums)],
                                                 names=[ROW, "n_best", "count_sum"])

        return linked.select(ROW, "pairs", "times").mapInArrow(run, f"{ROW} long, n_best long, count_sum long")

    parts = [looked_up(*r) for r in _ranges(counts, max_broadcast)]
    if len(parts) > 1:  # one range of counts on an executor at a time
        parts = [cut(p, "link-sums") for p in parts]
    sums = linked.select(ROW, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for p in parts:
        sums = sums.unionByName(p)
    sums = sums.groupBy(ROW).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (linked.drop("pairs", "times").join(sums, ROW)
            .select(id_col, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                    "groups_sha256"))
