"""Token alignment against a plain merge of the two token lists."""

import collections
import hashlib
import itertools
import json
import re

import pytest

from evoclust.llm import token_align as ta

VOCAB = "/opt/tokenizers/"
A, B = VOCAB + ta.A_FILE, VOCAB + ta.B_FILE
SCHEMA = "doc_id long, text string, n_a string, pairs string, lang string"


def texts():
    return [None, "", " ", "one", "Two words, and the rest.", "  spaces   in\n\nlines\t and tabs ", "x▁y has the mark",
            "<s> special </s> <|endoftext|> <0x41> <unk>", "été à l'œuvre — 日本語 \U0001f600 \0 end", "ﬁ ½ １ nbsp\xa0",
            "the same the same the same", "the same the same the same", "a" * 3000, "very long words " * 4000,
            "﻿bom", "é combining", "123456789 " * 50, "\r\n\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts())] + [(None, "no id here", None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain(rows):
    """Rows of the contract, document by document."""
    import sentencepiece
    from tokenizers import Tokenizer

    spec = json.load(open(A, encoding="utf-8"))
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = ta.byte_level_alphabet()
    names = {i: w for w, i in spec["model"]["vocab"].items()}
    out, found = [], []
    for doc_id, t in rows:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        a_bytes = [bytes(alphabet[c] for c in names[i]) for i in a]
        b_bytes = []
        for p in map(sp.id_to_piece, b):
            m = re.fullmatch("<0x(..)>", p)
            b_bytes.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode())
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        ea, eb = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
        both = sorted(set(ea) & set(eb))
        pa_, pb_, groups, linked = 0, 0, [], []
        at_a, at_b = {e: k for k, e in enumerate(ea)}, {e: k for k, e in enumerate(eb)}
        for e in both:
            i, j = at_a[e], at_b[e]
            groups.append(",".join(map(str, a[pa_:i + 1])) + "|" + ",".join(map(str, b[pb_:j + 1])))
            linked.append((a[i], b[j]))
            pa_, pb_ = i + 1, j + 1
        found.append(linked)
        out.append([doc_id, len(a), len(b), len(groups),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", both, a, b])
    n = collections.Counter(x for one in found for x in one)
    top = collections.Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return [(i, na, nb, g, len(one), sum(n[x] == top[x[1]] for x in one), sum(n[x] for x in one), h)
            for (i, na, nb, g, h, *_), one in zip(out, found)], out


def key(r):
    return (r[0] is None, r[0] or 0, r)


@pytest.mark.parametrize("lane,limit", [(512, 64 << 20), (7, 200), (1 << 30, 3000)])
def test_digests_match_plain_merge(docs, lane, limit):
    want, _ = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = [tuple(r) for r in ta.digests(docs, A, B, lane_bytes=lane, max_broadcast=limit).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[1] == 0 and r[0] is not None for r in got) and any(r[3] > 10_000 for r in got)


def test_align_gives_back_both_token_lists(docs):
    _, want = plain([(r.doc_id, r.text) for r in docs.collect()])
    by = {w[0]: w for w in want if w[0] is not None}
    for r in ta.align(docs, A, B).collect():
        if r.doc_id is not None:
            assert (r.a_ids, r.b_ids, r.cut_byte) == (by[r.doc_id][6], by[r.doc_id][7], by[r.doc_id][5])
            assert len(r.cut_a) == len(r.cut_b) == len(r.cut_byte)
            assert not r.cut_a or (r.cut_a[-1], r.cut_b[-1]) == (len(r.a_ids), len(r.b_ids))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ta.digests(none, A, B).count() == 0
    assert ta.align(none, A, B).count() == 0
