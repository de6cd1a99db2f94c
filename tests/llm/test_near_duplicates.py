"""Near-duplicate operators against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import common, embedding_dedup, ngram_forest, shingles
from nearfield.llm.shingles import shingle_sets


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, monkeypatch, seed):
    monkeypatch.setattr(common, "HOT_LEAST", [500, 3, 1][seed])
    r = random.Random(seed)
    n = 120
    links = [(r.randrange(n), r.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(100, 119)]
    edges = spark.createDataFrame([*links, *links[:5]], "a bigint, b bigint")
    want = plain_components(n, links)
    got = {x.id: x.component_id for x in common.components(edges).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: min(y for y in range(n) if want[y] == want[x]) for x in linked}
    assert common.components(edges.limit(0)).count() == 0


# --- embeddings -----------------------------------------------------------


def plain_vectors(rows, threshold=0.98):
    ok = lambda v, l: v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, links = len(rows), []
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if i is not None and ok(v, l) else None for i, v, l in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links.append((a, b))
    root, deg = plain_components(n, links), Counter(x for l in links for x in l)
    low = {}
    for k in range(n):
        if rows[k][0] is not None:
            low[root[k]] = min(low.get(root[k], rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], deg[k], low.get(root[k]) if rows[k][0] is not None else None) for k in range(n)), key=repr)


@pytest.mark.parametrize(("dim", "tile"), [(8, 8192), (8, 30), (3, 7), (1, 5), (64, 40)])
def test_embeddings_equal_brute_force(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(common, "HOT_LEAST", 500 if tile > 30 else 5)
    r = np.random.default_rng(dim * tile)
    centres = r.normal(size=(12, dim))
    rows = []
    for i in range(260):
        c = centres[r.integers(12)]
        v = (c + r.normal(size=dim) * np.linalg.norm(c) / np.sqrt(dim) * r.choice([0, 0.1, 0.2, 0.4])) * r.choice([1, 3, -1])
        rows.append((i * 3 % 260, v.astype(np.float32).tolist(), None if i % 50 == 7 else int(r.integers(3))))
    same = rows[0][1]
    rows += [(300 + i, same, 1) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * dim, 1), (402, [float("nan")] * dim, 1), (403, [float("inf")] * dim, 1), (404, [None] * dim, 1), (405, [], 1), (None, same, 1), (300, same, 1), (406, [*same, 0.0], 1), (407, [*same, 0.0], 1), (408, same, None), (409, [1e30 * x for x in same], 1), (410, [1e-30 * x for x in same], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as key")
    got = embedding_dedup.near_duplicates(frame, tile=tile)
    rows = [(a, [np.float32(x) for x in v] if v and v[0] is not None else v, l) for a, v, l in rows]
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got.collect()), key=repr) == plain_vectors(rows)
    assert got.where("kept != coalesce(vec_id = component_id, true)").count() == 0
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_a_thousand_lengths(spark):
    rows = [(2 * d + i, [float(i + 1)] * d, 0) for d in range(1, 1011) for i in (0, 1)]
    rows += [(9000 + i, [1.0, float(i), 0.0, 5.0], 1) for i in range(12)] + [(9100, [1.0, 1.0, 0.0, 5.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, tile=10).collect()}
    assert len(got) == len(rows)
    assert all(got[2 * d + i] == (1, 2 * d) for d in range(1, 1011) for i in (0, 1))
    alone = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame.where("label = 1")).collect()}
    assert got[9100] == (0, 9100) and {k: v for k, v in got.items() if 9000 <= k < 9100} == alone


# --- n-grams --------------------------------------------------------------


def plain_shingles(text, words=5):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    n = min(words, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_shingles_equal_plain_sets():
    r = random.Random(4)
    texts = ["", " ", "a", "A b", "one two three four five", "é日本 x", *(" ".join(r.choice(["a", "B", "cc", "é", "7", "a-b", "--"]) for _ in range(r.randrange(60))) for _ in range(300))]
    sets = shingle_sets(texts)
    plain = [plain_shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a in range(0, len(texts), 7):
        for b in range(len(texts)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])
    alone = [shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, sets, strict=True))


def test_words_that_polynomials_confuse():
    """The Thue-Morse word of 1024 letters and its complement, which have one hash modulo 2**64 for any multiplier."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    a, b = shingle_sets([word, word.translate(str.maketrans("ab", "ba"))])
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_word_tables_that_overflow():
    r = random.Random(8)
    texts = ["".join(r.choice("ab é.") for _ in range(r.randrange(400))) for _ in range(40)] + ["x" * 90 + " y z " + "w" * 300, "é" * 200]
    texts = [shingles.split_words(t) for t in texts]
    small = shingles.WordTable(3)
    for i in range(0, len(texts), 5):
        found, cut = shingles.hashed_sets(texts[i : i + 5], 5, small)
        again, same = shingles.hashed_sets(texts[i : i + 5])
        assert (found == again).all() and (cut == same).all()


def test_exact_sets_equal_plain_sets():
    r = random.Random(4)
    texts = ["", "a", "A b", "one two three four five", *(" ".join(r.choice(["a", "B", "cc", "é"]) for _ in range(r.randrange(30))) for _ in range(120))]
    for n in (1, 2, 5):
        sets = shingles.exact_sets([shingles.split_words(t) for t in texts], n)
        plain = [plain_shingles(t, n) for t in texts]
        assert [len(s) for s in sets] == [len(p) for p in plain]
        for a in range(0, len(texts), 5):
            for b in range(len(texts)):
                assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


@pytest.mark.parametrize("frequent", [2, 5, 24])
def test_intersections(monkeypatch, frequent):
    monkeypatch.setattr(ngram_forest, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_forest, "CELLS", 700)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 150, r.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    every = ngram_forest.intersections(sets, 40)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (every == want).all()
    assert (ngram_forest.intersections(sets, 15) == want[:15, 15:]).all()


def near_copies(seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    bases = [[word() for _ in range(r.choice([3, 5, 8, 30, 120, 400]))] for _ in range(25)]
    rows = []
    for i in range(500):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = word()
        rows.append((i * 7 % 500, " ".join(w) + r.choice(["", " ", "."])))
    hot = [word() for _ in range(80)]
    rows += [(1000 + i, " ".join([*hot[:i % 75], word(), *hot[i % 75 + 1 :]])) for i in range(150)]
    return rows + [(2000, None), (2001, ""), (2002, "!!"), (None, rows[0][1]), (3, rows[0][1]), (2003, "x"), (2004, "X"), rows[5], (2005, "q " * 30000)]


def plain_jaccard(rows):
    sets = [plain_shingles(t) for _, t in rows]
    links, same = [], []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                c = len(sets[a] & sets[b])
                if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                    links.append((a, b))
                    if sets[a] == sets[b]:
                        same.append((a, b))
    return links, same


@pytest.mark.parametrize(("tile", "node"), [(ngram_forest.TILE, ngram_forest.NODE), (3000, 20)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, tile, node):
    monkeypatch.setattr(ngram_forest, "NODE", node)
    monkeypatch.setattr(common, "HOT_LEAST", 500 if node > 20 else 5)
    rows = near_copies()
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, node int")
    links, same = plain_jaccard(rows)
    n = len(rows)
    deg = Counter(x for l in links for x in l)

    def lowest(pairs):
        root, low = plain_components(n, pairs), {}
        for k in range(n):
            if rows[k][0] is not None:
                low[root[k]] = min(low.get(root[k], rows[k][0]), rows[k][0])
        return [low.get(root[k]) if rows[k][0] is not None else None for k in range(n)]

    want = sorted(zip((i for i, _ in rows), lowest(same), (deg[k] for k in range(n)), lowest(links), strict=True), key=repr)
    got = ngram_forest.jaccard_join(frame, tile=tile)
    assert sorted((tuple(x)[:4] for x in got.collect()), key=repr) == want
    kept = ngram_forest.without_near_duplicates(frame, tile=tile)
    assert kept.columns == frame.columns
    assert sorted([x.doc_id for x in kept.collect()], key=repr) == sorted([None, *{i for i, _, _, c in want if i == c and i is not None}], key=repr)
    assert ngram_forest.jaccard_join(frame.limit(0)).count() == 0


def test_confusing_words_stay_apart(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    frame = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "other words")], "doc_id bigint, text string")
    assert sorted(x.doc_id for x in ngram_forest.without_near_duplicates(frame).collect()) == [1, 2, 3]


def test_prefixes_are_as_short_as_the_target_needs():
    assert ngram_forest.depth_for(0.8) == 4 and ngram_forest.depth_for(0.99) == ngram_forest.MAX_DEPTH
    assert 1 - (1 - 0.8**4) ** ngram_forest.TRIES >= ngram_forest.TARGET > 1 - (1 - 0.8**5) ** ngram_forest.TRIES
    assert ngram_forest.first_depth(0.8, 4) == 8
    none, last = [0] * ngram_forest.BINS, ngram_forest.BINS - 1
    need = lambda links: ngram_forest.needed_depth([*links], 8, 4, 0.8)
    assert need(none) == 4  # nothing is known of links near the threshold
    copies, far = list(none), list(none)
    copies[last], far[0] = 10**7, 10**4
    assert need(copies) == 8 and need(far) == 4
    assert ngram_forest.needed_depth(far, 5, 4, 0.8, target=0.9) == 5


@pytest.mark.parametrize("node", [ngram_forest.NODE, 4])
def test_trie_edges_connect_each_node(monkeypatch, node):
    monkeypatch.setattr(ngram_forest, "NODE", node)
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(2, 14))
        levels = r.integers(0, 2, (n, ngram_forest.LEVELS)).astype(np.uint64)
        tails = np.sort(sum(levels[:, k] << np.uint64(48 - 16 * k) for k in range(ngram_forest.LEVELS)).view(np.int64))
        sketches = np.zeros((n, 4), np.uint64) if r.random() < 0.5 or node < n else (np.uint64(0) - r.integers(0, 2, (n, 1)).astype(np.uint64)).repeat(4, 1)
        i, j, k = ngram_forest.trie_edges(tails, sketches, 40)
        assert len(i) < n
        for level in range(ngram_forest.LEVELS + 1):
            cut = tails.view(np.uint64) >> np.uint64(64 - 16 * level) if level else np.zeros(n, np.uint64)
            want = [(a, b) for a in range(n) for b in range(a) if cut[a] == cut[b] and (sketches[a] == sketches[b]).all()]
            assert plain_components(n, [(a, b) for a, b, c in zip(i, j, k, strict=True) if c >= level]) == plain_components(n, want)


def test_recall_by_similarity(spark):
    """Pairs of every similarity from the threshold on meet, though prefixes start at their longest."""
    r = random.Random(12)
    rows = []
    for i in range(600):
        w = [f"{i}w{k}" for k in range(104)]
        x = list(w)
        for at in r.sample(range(0, 100, 5), i % 3):
            x[at + 2] = f"n{i}x{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sets = {i: plain_shingles(t) for i, t in rows}
    linked = {r.doc_id for r in ngram_forest.jaccard_join(frame).where("n_links = 1").collect()}
    for i in range(600):
        a, b = sets[2 * i], sets[2 * i + 1]
        want = 5 * len(a & b) >= 4 * len(a | b)
        assert (2 * i in linked, 2 * i + 1 in linked) == (want, want)
