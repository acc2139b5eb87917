"""Collocations against a plain count of every phrase."""

import collections
import re

import numpy as np
import pytest

from evoclust.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n string, phrase string"


def texts():
    rng = np.random.default_rng(3)
    vocab = ["The", "the", "of", "ÉTÉ", "été", "règle", "sea", "a", "b", "x-y", "\U0001f600", "nbsp\xa0word", "moon", "~"]
    out = [None, "", " .,; \n", "one", "Big BIG big " * 40, "a b c " * 3000, "x" * 4000, "a b\r\na b\x0ba b\x0ca b", "ab\tcd\x1f ef"]
    for _ in range(150):
        words = rng.choice(vocab, rng.integers(1, 80), p=np.arange(14, 0, -1) / 105)
        out.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for w in words))
    return out + out[-5:]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "fr", None, "und", "en"]
    rows = [(i, t, langs[i % 5], "x", "y") for i, t in enumerate(texts())] + [(None, "big big big the sea", "en", None, None)] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(rows, min_count, cover, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= cover * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("counting", [{}, {"burst": 8, "max_entries": 90, "group_bytes": 5000},
                                      {"burst": 10**9, "max_words": 5}])
@pytest.mark.parametrize("limits", [(10, 50, 2000), (2, 80, 7)])
def test_collocations_match_plain_counts(docs, counting, limits):
    got = co.collocations(docs, *limits, **counting)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain([(r.text, r.lang) for r in docs.collect()], *limits)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 15


def test_all_counts(docs, monkeypatch):
    monkeypatch.setattr(co, "MERGE", 100)
    got = {(r.lang, r.phrase): r.n for r in co.phrase_counts(docs, burst=16, max_entries=200).collect()}
    assert got["en", "big big big"] == 118 + 3 and got["en", "big big"] == 119 + 6 and got["en", "big"] == 120 + 9
    assert got["en", "the sea"] >= 3 and ("en", "") in got


def test_trie_keeps_every_count():
    rng = np.random.default_rng(0)
    trie, want = co.Node(0, 32), collections.Counter()
    for _ in range(60):
        w = rng.zipf(1.3, (400, 3)) % 300 + 1
        w[rng.random(400) < 0.3, 2] = 0
        w[rng.random(400) < 0.1, 1:] = 0
        key = w[:, 0] << 42 | w[:, 1] << 21 | w[:, 2]
        trie.add(*np.unique(key, return_counts=True))
        want.update(key.tolist())
    keys, n = (np.concatenate(x) for x in zip(*trie.all()))
    assert dict(zip(keys.tolist(), n.tolist())) == want and len(keys) == trie.size()
    assert trie.kids and any(k.kids for k in trie.kids.values())


def test_scores_beyond_64_bits(spark):
    rows = [(10**12, 10**12, 10**12), (3 * 10**13 + 1, 7 * 10**14, 9 * 10**15), (10, 10, 11), (10**15, 10**15, 10**15 + 1)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", co._score("a", "l", "r").alias("s"))
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in got.collect())


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert co.collocations(none).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).count() == 0
