"""Collocations: phrases of two and three words, counted in burst tries.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
into words ``[^\\x20\\x09]+``; everything is counted per language (null:
``und``), overlaps included, over whole texts.

Counting (HAT-trie): a task gives its words integer ids and keeps, for each
language, a shallow trie over word ids.  A node's phrases lie in one hash
container (NumPy, open addressing); when it holds over ``burst`` entries, the
next words with many phrases burst out into nodes of their own.  When a task
holds ``max_entries`` entries, whole subtrees (the largest first, until half is
left) leave as runs sorted by their words' bytes, and so does the rest at the
end or when ``max_words`` words have ids.  A run is cut by prefix partition
(hash of the first two words; third words are spread over ``SPREAD`` parts, so
that a prefix followed by ever new words is not one group) into compressed
blocks.  The runs of a partition are merged in one group of about
``group_bytes`` bytes of text, whatever the corpus: the number of partitions
follows the bytes of text.

Scores: a phrase found at least ``min_count`` times is a candidate; cut after
its first k words it scores ``floor(1000000 a a / (l r))`` with a, l, r the
counts of phrase, first part and rest; the lowest-scoring cut counts, ties to
the smallest k.  The arithmetic is on decimals of 38 digits: exact up to
counts of 10^16.  Candidates inside a longer candidate with at least
``cover`` per cent of their count go; each language's first ``top`` stay.

Defined results: null and empty texts hold no words; a table without words
gives no rows; repeated rows and ids count each time; ties of score go by
count, then by the phrase's UTF-8 bytes.  Bytes that are no UTF-8 read as
U+FFFD.  Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.session import cut

SPREAD = 64
ROWS = 1 << 17   # phrases of a block
MERGE = 1 << 19  # least number of entries merged at once
CHUNK = 2 << 20  # bytes of text counted at once

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE_END.copy()
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- counting

WORD_BITS = 21
MASK = (1 << WORD_BITS) - 1
EMPTY = np.int64(-1)


class HashContainer:
    """Phrase keys and counts in one open-addressing table."""

    def __init__(self, size: int = 64):
        self.keys, self.n, self.used = np.full(size, EMPTY), np.zeros(size, np.int64), 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Adds counts of different keys."""
        if 4 * (self.used + len(keys)) > 3 * len(self.keys):
            old = self.items()
            size = len(self.keys)
            while 4 * (self.used + len(keys)) > 3 * size:
                size *= 2
            self.keys, self.n, self.used = np.full(size, EMPTY), np.zeros(size, np.int64), 0
            self._put(*old)
        self._put(keys, n)

    def _put(self, keys, n):
        last = len(self.keys) - 1
        at = (tk.mix(keys.astype(np.uint64)) & np.uint64(last)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[free]  # of several keys the last one stays
            mine = self.keys[at] == keys
            self.n[at[mine]] += n[mine]
            self.used += int((free & mine).sum())
            left = ~mine
            keys, n, at = keys[left], n[left], (at[left] + 1) & last

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.keys != EMPTY)
        return self.keys[some], self.n[some]


class Node:
    """Phrases that share their first ``level`` words: a container, and a node
    of its own for each next word that burst out."""

    def __init__(self, level: int, burst: int):
        self.level, self.burst, self.limit = level, burst, burst
        self.box, self.kids = HashContainer(), {}

    def _word(self, keys: np.ndarray) -> np.ndarray:
        return keys >> (WORD_BITS * (2 - self.level)) & MASK

    def size(self) -> int:
        return self.box.used + sum(k.size() for k in self.kids.values())

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Adds counts of different keys in rising order."""
        if self.kids and len(keys):
            word, mine = self._word(keys), np.ones(len(keys), bool)
            names = np.array(sorted(self.kids))
            lo, hi = np.searchsorted(word, names), np.searchsorted(word, names, "right")
            for w, a, b in zip(names[lo < hi].tolist(), lo[lo < hi], hi[lo < hi]):
                self.kids[w].add(keys[a:b], n[a:b])
                mine[a:b] = False
            keys, n = keys[mine], n[mine]
        self.box.add(keys, n)
        if self.box.used > self.limit and self.level < 2:
            self._burst()

    def _burst(self) -> None:
        keys, n = self.box.items()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        words, first, many = np.unique(self._word(keys), return_index=True, return_counts=True)
        stay = np.ones(len(keys), bool)
        for w, a, m in zip(words.tolist(), first, many):
            if w and m > self.burst // 8:  # word 0: the phrase ends here
                kid = self.kids[w] = Node(self.level + 1, self.burst)
                kid.add(keys[a:a + m], n[a:a + m])
                stay[a:a + m] = False
        self.box = HashContainer()
        self.box.add(keys[stay], n[stay])
        self.limit = max(self.burst, 2 * self.box.used)  # many small subtrees share a container

    def all(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.box.items(), *(x for k in self.kids.values() for x in k.all())]


class PhraseCounter:
    """Everything a task counts: word ids and a trie for each language."""

    def __init__(self, parts: int, burst: int, max_entries: int, max_words: int):
        self.parts, self.burst, self.max_entries, self.max_words = parts, burst, max_entries, max_words
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}  # from 1; 0: no word
        self.tries: dict[str, Node] = {}
        self.total: Counter = Counter()

    def add(self, lang: str, buf: np.ndarray, offsets: np.ndarray) -> None:
        s, e, row = tk.spans(buf, offsets, GAP)
        if len(s) == 0:
            return
        # the words, one after another, as a dictionary-encoded string array
        flat = LOWER[buf[~GAP[buf]]]
        off = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(flat)).dictionary_encode()
        ids = self.ids
        known = np.array([ids.setdefault(w, len(ids) + 1) for w in _utf8(coded.dictionary)], np.int64)
        w = known[coded.indices.to_numpy()]
        self.total[lang] += len(w)
        # words i and i+1 are neighbours if no piece ends between them
        ends = np.concatenate([[0], np.cumsum(PIECE_END[buf])])
        near = (row[1:] == row[:-1]) & (ends[s[1:]] == ends[e[:-1]])
        one = w << (2 * WORD_BITS)
        two = (one[:-1] | w[1:] << WORD_BITS)[near]
        three = (one[:-2] | w[1:-1] << WORD_BITS | w[2:])[near[1:] & near[:-1]]
        keys, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        self.tries.setdefault(lang, Node(0, self.burst)).add(keys, n)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Runs that have to leave now."""
        if len(self.ids) > self.max_words:
            yield from self.rest()
            return
        entries = sum(t.size() for t in self.tries.values())
        if entries <= self.max_entries:
            return
        subtrees = [(k.size(), lang, w) for lang, t in self.tries.items() for w, k in t.kids.items()]
        subtrees += [(t.box.used, lang, 0) for lang, t in self.tries.items()]
        out: dict[str, list] = {}
        for size, lang, w in sorted(subtrees, reverse=True):
            trie = self.tries[lang]
            if w:
                out.setdefault(lang, []).extend(trie.kids.pop(w).all())
            else:
                out.setdefault(lang, []).append(trie.box.items())
                trie.box, trie.limit = HashContainer(), self.burst
            entries -= size
            if entries <= self.max_entries // 2:
                break
        words = Words(self.ids)
        for lang, items in out.items():
            yield from words.run(lang, items, self.parts)
        pa.default_memory_pool().release_unused()

    def rest(self) -> Iterator[pa.RecordBatch]:
        words = Words(self.ids)
        for lang, trie in self.tries.items():
            yield from words.run(lang, trie.all(), self.parts)
            yield _block(lang, 0, b"\n", np.array([self.total[lang]]))  # the empty phrase counts the words
        self._clear()


def _utf8(words: pa.Array) -> list[str]:
    try:
        return words.to_pylist()
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in words.cast(pa.binary()).to_pylist()]


class Words:
    """A task's words by id: their texts, byte order and hashes."""

    def __init__(self, ids: dict[str, int]):
        w = pa.array(["", *ids], pa.string())
        self.count = len(w)
        self.rank = np.empty(len(w), np.int64)
        self.rank[pc.array_sort_indices(w.cast(pa.binary())).to_numpy()] = np.arange(len(w))  # '' comes first
        off = np.frombuffer(w.buffers()[1], np.int32)[:len(w) + 1].astype(np.int64)
        buf = np.frombuffer(w.buffers()[2], np.uint8) if off[-1] else np.zeros(0, np.uint8)
        self.hash = np.zeros(len(w), np.uint64)
        self.hash[1:] = tk.span_hash(buf, off[1:-1], off[2:], fold=False)
        # every word followed by a space, by the end of its phrase, and no word
        self.text = pa.concat_arrays([pc.binary_join_element_wise(w, x, "") for x in (" ", "\n")] + [pa.array([""], pa.string())])

    def run(self, lang: str, items: list, parts: int) -> Iterator[pa.RecordBatch]:
        """One sorted run, cut by prefix partition."""
        keys = np.concatenate([k for k, _ in items])
        n = np.concatenate([c for _, c in items])
        if len(keys) == 0:
            return
        w = [keys >> (2 * WORD_BITS), keys >> WORD_BITS & MASK, keys & MASK]
        h = [self.hash[x] for x in w]
        part = (tk.pair_hash(tk.pair_hash(h[0], h[1]), h[2] % np.uint64(SPREAD)) % np.uint64(parts)).astype(np.int64)
        place = self.rank[w[0]] << (2 * WORD_BITS) | self.rank[w[1]] << WORD_BITS | self.rank[w[2]]
        order = np.lexsort((place, part))
        part, n, w = part[order], n[order], [x[order] for x in w]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        no_word = 2 * self.count
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for a in range(lo, hi, ROWS):
                b = min(a + ROWS, hi)
                one, two, three = (x[a:b] for x in w)
                at = (one + self.count * (two == 0), np.where(two > 0, two + self.count * (three == 0), no_word),
                      np.where(three > 0, three + self.count, no_word))
                text = pc.binary_join_element_wise(*(self.text.take(pa.array(x)) for x in at), "")
                yield _block(lang, int(part[lo]), text.buffers()[2], n[a:b])


BLOCK = "lang string, part long, size long, words binary, counts binary"


def _block(lang: str, part: int, words, n: np.ndarray) -> pa.RecordBatch:
    words, n = pa.py_buffer(words), np.ascontiguousarray(n, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang], pa.string()), pa.array([part], pa.int64()), pa.array([words.size], pa.int64()),
         *(pa.array([pa.compress(x, codec="zstd", asbytes=True)], pa.binary()) for x in (words, pa.py_buffer(n)))],
        names=[c.split()[0] for c in BLOCK.split(", ")])


def _phrases(block: bytes, size: int) -> pa.Array:
    """The phrases of a block, each of which ends in a line feed."""
    buf = np.frombuffer(pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    end = np.flatnonzero(buf == 0x0A)
    off = np.concatenate([[0], end + 1]) - np.arange(len(end) + 1)
    return pa.LargeStringArray.from_buffers(len(end), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(buf[buf != 0x0A]))


def phrase_counts(docs: DataFrame, at_least: int = 1, lang_col: str = "lang", text_col: str = "text", burst: int = 8192,
                  max_entries: int = 1 << 20, max_words: int = 1 << 20, group_bytes: int = 8 << 20) -> DataFrame:
    """``lang, phrase, n``: exact counts of the phrases of one to three words
    found at least ``at_least`` times; the empty phrase counts the
    language's words."""
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = 1 + (d.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // group_bytes

    def run(batches):
        c = PhraseCounter(parts, burst, min(max_entries, MASK), min(max_words, MASK >> 1))
        for rb in batches:
            langs = rb.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for _, _, buf, off in tk.chunks(rb.column(1).filter(pa.array(code == k)), CHUNK):
                    c.add(lang, buf, off)
                    yield from c.spill()
        yield from c.rest()

    def merge(group: pa.Table) -> pa.Table:
        phrases, n, held, known = [], [], 0, 0

        def merged():
            coded = pa.concat_arrays(phrases).dictionary_encode()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, coded.indices.to_numpy(), np.concatenate(n))
            return [coded.dictionary], [total]

        for size, words, counts in zip(*(group[c].to_pylist() for c in ("size", "words", "counts"))):
            phrases.append(_phrases(words, size))
            n.append(np.frombuffer(pa.decompress(counts, decompressed_size=8 * len(phrases[-1]), codec="zstd", asbytes=True), np.int64))
            held += len(n[-1])
            if held > max(MERGE, known):  # what is held between merges is the different phrases
                phrases, n = merged()
                held, known = 0, len(n[0])
        (phrases,), (n,) = merged()
        pa.default_memory_pool().release_unused()
        some = (n >= at_least) | (pc.binary_length(phrases).to_numpy() == 0)
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * int(some.sum()), pa.string()),
                         "phrase": phrases.filter(pa.array(some)).cast(pa.string()), "n": pa.array(n[some])})

    return d.mapInArrow(run, BLOCK).groupBy("lang", "part").applyInArrow(merge, "lang string, phrase string, n long")


# ------------------------------------------------------------------ scores

def _score(a: str, lft: str, rgt: str) -> Column:
    d = "decimal(38,0)"
    return F.expr(f"(cast(1000000 as {d}) * cast({a} as {d}) * cast({a} as {d})) "
                  f"div (cast({lft} as {d}) * cast({rgt} as {d}))").cast("long")


def collocations(docs: DataFrame, min_count: int = 10, cover: int = 50, top: int = 2000, lang_col: str = "lang",
                 text_col: str = "text", **counting) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    # every count that the scores need is at least that of a candidate
    found = cut(phrase_counts(docs, min_count, lang_col, text_col, **counting), "phrases")
    total = found.filter("phrase = ''").select("lang", "n")  # a row a language
    some = found.filter("phrase <> ''").withColumn("__w", F.split("phrase", " "))
    w = [F.col("__w")[k] for k in range(3)]
    one = some.filter("size(__w) = 1").select("lang", F.col("phrase").alias("p"), F.col("n").alias("f"))
    two = some.filter("size(__w) = 2").select("lang", "phrase", w[0].alias("w1"), w[1].alias("w2"), F.col("n").alias("a"))
    three = some.filter("size(__w) = 3").select(
        "lang", "phrase", F.concat_ws(" ", w[0], w[1]).alias("head"), F.concat_ws(" ", w[1], w[2]).alias("tail"),
        w[0].alias("w1"), w[2].alias("w3"), F.col("n").alias("a"))

    def count_of(df: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
        return df.join(counts.toDF("lang", part, name), ["lang", part])

    pairs = two.select("lang", "phrase", "a")
    got3 = count_of(count_of(count_of(count_of(three, "head", pairs, "f12"), "tail", pairs, "f23"), "w1", one, "f1"), "w3", one, "f3")
    got3 = got3.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    got3 = got3.select("lang", "phrase", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    got2 = count_of(count_of(two, "w1", one, "l"), "w2", one, "r")
    over = (three.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    got2 = (got2.join(over, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
            .select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score")))
    # each language's first rows, taken within parts first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    best = (got2.unionByName(got3).withColumn("__part", part)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)))
            .filter(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= top))
    return (best.join(F.broadcast(total), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle(min_count: int = 10, cover: int = 50, top: int = 2000) -> str:
    """The same in DuckDB SQL over ``documents``."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, i, w, unnest([1, 2, 3]) AS k FROM i),
c AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE f >= {min_count}),
x AS (SELECT lang, phrase, k, f AS a, w, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT x.lang, x.phrase, x.k, x.a, x.j, l.f AS l, r.f AS r,
        CAST((1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.j], ' ')
             JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, f AS a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM f WHERE k = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
      WHERE o.longer IS NULL OR o.longer * 100 < b.a * {cover})
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score FROM d JOIN t ON t.lang = d.lang
QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
