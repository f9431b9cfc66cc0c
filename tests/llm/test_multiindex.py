import math

import numpy as np

import millrace.llm.multiindex as mi
from millrace.llm.multiindex import near_vectors, traverse


def brute(rows, cosine):
    links = {i: set() for i in range(len(rows))}
    ok = [v is not None and lab is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, lab in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_recall_and_precision(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    links = brute(rows, 0.93)
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    want = sum(map(len, links.values()))
    assert 0.9 * want <= sum(r["n_links"] for r in got.values()) <= want
    assert all(got[rows[i][0]]["n_links"] <= len(s) for i, s in links.items())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_noisy_pairs_at_the_threshold(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((300, 16))
    rows = []
    for i, b in enumerate(base):
        b = b / np.linalg.norm(b)
        t = r.standard_normal(16)
        t -= (t @ b) * b
        y = 0.94 * b + math.sqrt(1 - 0.94**2) * t / np.linalg.norm(t)
        rows += [(2 * i, [float(x) for x in b], i % 2), (2 * i + 1, [float(x) for x in y], i % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sum(map(len, brute(rows, 0.93).values()))
    got = sum(x["n_links"] for x in near_vectors(df).collect())
    assert 0.9 * want <= got <= want


def components(rows, links):
    root = list(range(len(rows)))
    for _ in rows:
        for i, s in links.items():
            low = min([root[i], *(root[j] for j in s)])
            for j in (i, *s):
                root[j] = min(root[j], low)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    return [(rows[i][0], len(links[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows))]


def test_small_lengths_are_exact_and_minorities_link(spark):
    """Lengths with few vectors are compared in full: rows equal brute force, components included."""
    r = np.random.default_rng(3)
    rows, n = [], 0
    for width, count in ((64, 60), (16, 25), (3, 30), (1, 4)):
        base = r.standard_normal((count // 4 + 1, width))
        for i in range(count):
            rows.append((n, [float(x) for x in base[i % len(base)] + 0.12 * r.standard_normal(width)], i % 2))
            n += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = components(rows, brute(rows, 0.93))
    assert sorted(map(tuple, near_vectors(df).collect())) == sorted(want) and any(w[1] for w in want if len(rows[w[0]][1]) == 16)


def test_recall_and_components_with_codebooks(spark, sf, monkeypatch):
    monkeypatch.setattr(mi, "SIDE", 40)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    links = brute(rows, 0.93)
    want = {d: (n, c) for d, n, c, _ in components(rows, links)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[d][0] <= want[d][0] for d in want)
    assert sum(got[d] == want[d] for d in want) >= 0.9 * len(want)


def test_visits_grow_until_the_recall_is_met():
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = (mi._kmeans(x[:, :16], 40, 4, r), mi._kmeans(x[:, 16:], 40, 4, r))
    n, share = mi.visits_needed(x[:300], x[300:600], books, 0.95)  # strangers: most cells must be seen
    assert n > 512 and share >= 0.95
    own = traverse(x[:600], books, n)
    met = [(own[i] == own[300 + i, 0]).any() or (own[300 + i] == own[i, 0]).any() for i in range(300)]
    assert np.mean(met) == share


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (0, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [1.0], 1), (14, [3.0], 1), (15, [], 1), (16, [], 1), (12, [1.0, 0.01], 2), (13, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame([(*x, 3, "q") for x in rows], "vec_id long, embedding array<double>, label int, node int, vec string")
    got = sorted(map(tuple, near_vectors(df).collect()))
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 1, 11, True), (12, 0, 12, True), (13, 0, 13, True), (14, 1, 11, False), (15, 0, 15, True), (16, 0, 16, True)]
    assert near_vectors(df.limit(0)).collect() == []


def test_traversal_order():
    r = np.random.default_rng(1)
    books = (r.standard_normal((6, 2)), r.standard_normal((5, 3)))
    x = r.standard_normal((4, 5))
    for row, cells in zip(x, traverse(x, books, 12)):
        d = {i * 5 + j: ((row[:2] - a) ** 2).sum() + ((row[2:] - b) ** 2).sum() for i, a in enumerate(books[0]) for j, b in enumerate(books[1])}
        assert cells.tolist() == sorted(d, key=d.get)[:12]
