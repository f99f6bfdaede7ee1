"""The n-gram Jaccard join against brute force."""

import random

import numpy as np

from presswork.llm import overlap

from . import brute


def check(docs, n, num, den):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute.components(rows, n, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap.near_duplicates(docs, n, num, den).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert got == want
    return sum(i != c for i, (_, c) in want.items())


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check(docs, 3, 90, 100) > 20


def test_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 60)}"
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice((4, 12, 40, 150, 600)))]
        for _ in range(40):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            text = copy if rng.random() < 0.3 else text
            rows.append((len(rows) * 7 - 100, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check(docs, 3, 90, 100) > 50
    assert check(docs, 2, 8, 10) > 50
    left = overlap._found(docs, overlap.Link(2, 8, 10), "doc_id", "text").clusters.count()
    monkeypatch.setattr(overlap, "CROWD", 2)  # points leave nodes of more than two, if they can
    assert check(docs, 2, 8, 10) > 50
    assert left > 0


def test_left_nodes_lose_no_link():
    """Whichever m nodes each point leaves, two points that link still share one."""
    rng = np.random.default_rng(6)
    link = overlap.Link(2, 8, 10)
    for size in (6, 30, 90, 200, 700):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 62, size)).astype(np.uint64)
            differ = int(len(a) * 2 // 8)
            gone = rng.integers(0, differ + 1)
            b = np.concatenate((a[gone // 2 :], rng.integers(0, 1 << 62, (gone + 1) // 2).astype(np.uint64)))
            shared = len(np.intersect1d(a, b))
            if 10 * shared < 8 * (len(a) + len(b) - shared):
                continue
            owner, node = overlap.slab_values([np.sort(a), np.sort(b)], link)
            both = np.intersect1d(node[owner == 0], node[owner == 1])
            least = min(-(-len(x) * 8 // 10) for x in (a, b))
            assert len(both) > link.spare(least * 2 // 8)


def test_odd(spark):
    docs = spark.createDataFrame(list(enumerate(brute.ODD)), "doc_id long, text string")
    check(docs, 3, 90, 100)
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "A b C d"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in overlap.near_duplicates(rows, 3, 90, 100).collect()), key=str)
    assert got == [(0, 2, None), (5, 2, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5)]
    assert overlap.near_duplicates(docs.limit(0)).count() == 0


def test_spanning_pairs():
    link = overlap.Link(3, 90, 100)
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, size)).astype(np.uint64) for size in (40, 70, 130, 131, 300)]
    points = []
    for i in range(300):
        s = base[i % 5].copy()
        s[rng.integers(0, len(s), 1 + len(s) // 40)] = rng.integers(0, 1 << 62, 1 + len(s) // 40)
        s = np.unique(s)
        points.append((i, i // 2 if i < 40 else i, len(s), np.frombuffer(overlap.fine_counts(s), np.uint16), 0))
    parent = {x[1]: x[1] for x in points}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for x in points:
        for y in points:
            if overlap.allowed(x[3], y[3], x[2], y[2], link):
                a, b = find(x[1]), find(y[1])
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in parent}
    got = overlap.spanning(list(points), link)
    assert len(got) == len(parent) - len(set(want.values()))
    parent = {x[1]: x[1] for x in points}
    for a, b in got:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: find(i) for i in parent} == want and 1 < len(set(want.values())) < 100
    parent = {x[1]: x[1] for x in points}
    sides = ([x for x in points if x[0] % 2 == 0], [x for x in points if x[0] % 2], [(*x[:4], x[0] % 2) for x in points])
    for a, b in (y for side in sides for y in overlap.spanning(list(side), link)):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: find(i) for i in parent} == want


def test_roots():
    rng = np.random.default_rng(3)
    roots, parent = overlap.Roots(200), list(range(200))
    for _ in range(8):
        a, b = rng.integers(0, 200, (2, 15))
        roots.join(a, b)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            lo, hi = sorted((parent[x], parent[y]))
            parent = [lo if p == hi else p for p in parent]
    assert roots.of.tolist() == parent


def test_dropped_copies(spark):
    rows = [(4, "a b c d e f", "x"), (4, "q r s t u v", "x"), (4, "q r s t u v", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, "a b c d e f", "z"), (7, "", None), (8, None, None), (9, "A B c d e f", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near_id string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["_near_id"] or "") for r in overlap.drop_near_duplicates(docs).collect())
    assert got == [(0, "a b c d e f", "z"), (0, "a b c d e f", "z"), (2, "a b c d e f", "y"), (4, "q r s t u v", "x"), (7, "", ""), (8, "", "")]


def all_pairs(rows, n, num, den):
    """{(least id, least id): (shared, union)} of all links of different sets, and the least id of each id's set."""
    sets, least = {}, {}
    for i, t in sorted(rows):
        w = [x.translate(brute.AZ) for x in brute.words(t)]
        s = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} - {()})
        least[i] = sets.setdefault(s, i)
    sets = sorted((i, s) for s, i in sets.items() if s)
    found = ((a, b, len(x & y), len(x | y)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :])
    return {(a, b): (c, u) for a, b, c, u in found if den * c >= num * u}, least


def test_all_links(spark, monkeypatch):
    rng = random.Random(2)
    rows, word = [], lambda: f"w{rng.randint(0, 500)}"
    for size, copies in ((60, 90), (200, 40), (5, 3), (120, 2)):
        text = [word() for _ in range(size)]
        for _ in range(copies):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + size // 40)):
                copy[rng.randrange(size)] = word()
            text = copy if rng.random() < 0.1 else text
            rows.append((len(rows) + 5, " ".join(copy)))
    rows += [(1, rows[3][1].upper()), (900, rows[3][1]), (901, "")]
    want, least = all_pairs(rows, 3, 80, 100)
    degree = {i: sum(least[i] in ab for ab in want) for i, _ in rows}
    assert max(degree.values()) > 20
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    components = {i: c for i, (_, c) in brute.components(rows, 3, 80, 100).items()}
    for limit in (overlap.PAGE_GROUP, 25):  # whole, and dealt out by parts
        monkeypatch.setattr(overlap, "PAGE_GROUP", limit)
        assert {r["doc_id"]: r["component_id"] for r in overlap.near_groups(docs, 3, 80, 100).collect()} == {i: c for i, c in components.items() if i != 901}
        assert {r["doc_id"]: r["n_links"] for r in overlap.near_duplicates(docs, 3, 80, 100).collect()} == degree
        got = overlap.near_pairs(docs, 3, 80, 100).collect()
        assert len(got) == len(want) and {(r["doc_a"], r["doc_b"]): (r["shared"], r["n_union"]) for r in got} == want


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert overlap.overlaps(sets, sets).tolist() == want and overlap.overlaps(sets[:2], sets[:3]).tolist() == [r[:3] for r in want[:2]]
