"""Repeated byte strings against brute force over all positions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import queries, suffix_dedup


def plain(texts, length, first=False):
    data = [(t or "").encode() for t in texts]
    strings = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    seen, out = set(), []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen if first else strings[s] > 1:
                gone[i : i + length] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    prose = lambda k: "".join(word() for _ in range(k))
    passages = [prose(r.randrange(3, 30)) for _ in range(8)] + ["a" * 70, "xy" * 40]
    out = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else prose(r.randrange(0, 12)) for _ in range(r.randrange(6))]
        out.append("".join(parts))
    return out + [out[3], out[3], "", None, "b" * 300, "z" * 25]


@pytest.mark.parametrize(("length", "gram", "hot", "first"), [(20, 6, 20000, False), (20, 6, 20000, True), (20, 20, 20000, False), (33, 8, 3, False), (33, 8, 3, True), (7, 1, 20000, False)])
def test_equals_brute_force(spark, monkeypatch, length, gram, hot, first):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 150)
    monkeypatch.setattr(suffix_dedup, "RANKED", 900)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 500 if hot > 3 else 2)
    texts = corpus(length + hot)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, hash int, start string")
    got = {x.doc_id: (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), x.kept_sha256) for x in suffix_dedup.remove_repeats(frame, length=length, gram=gram, hot=hot, keep_first=first).collect()}
    assert got == dict(enumerate(plain(texts, length, first)))
    assert suffix_dedup.remove_repeats(frame.limit(0), length=length, gram=gram).count() == 0


def test_odd_keys(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(400))
    rows = [(None, t), (None, t[:250]), (1, t), (1, t), (1, "x" + t[100:]), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain([t for _, t in rows], 200)
    assert sorted(tuple(x)[1:] for x in suffix_dedup.report(frame).collect()) == sorted(want)


def test_registered_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x)[1:5] for x in queries.op4_suffix_dedup(spark, sf).collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain([d.text for d in docs], 200), strict=True))
    assert any(x[1] for x in got.values())


def test_ranks_are_suffix_order():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 300).astype(np.uint8)
    for length in (1, 2, 7, 40):
        rank = suffix_dedup.SuffixOrder(text, length).rank
        cut = [bytes(text[i : i + length]) for i in range(len(text))]
        order = sorted(set(cut))
        assert [order.index(c) for c in cut] == rank.tolist()


@pytest.mark.parametrize(("letters", "length"), [(2, 40), (1, 9), (2, 7), (4, 200), (3, 33)])
def test_longest_previous_factors_equal_brute_force(letters, length):
    r = np.random.default_rng(letters * length)
    text = r.integers(97, 97 + letters, 260).astype(np.uint8)
    text[130:200] = text[20:90]
    data, n = bytes(text), len(text)
    suffixes = suffix_dedup.SuffixOrder(text, length)
    order = np.argsort(suffixes.rank, kind="stable")[: n]
    order = order[order <= n - length] if n >= length else order[:0]
    share = lambda p, q: next((k for k in range(length) if data[p + k] != data[q + k]), length)
    common = np.concatenate([[0], suffixes.common(order[:-1], order[1:])])
    assert common[1:].tolist() == [share(p, q) for p, q in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    factor, source = suffix_dedup.longest_previous_factors(order, common)
    for p, f, s in zip(order.tolist(), factor.tolist(), source.tolist(), strict=True):
        assert f == max([share(p, q) for q in range(p)], default=0)
        assert f == 0 if s == -1 else s < p and share(p, s) == f
