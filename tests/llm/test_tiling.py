import random
import tracemalloc

import numpy as np

from millrace.llm.tiling import contaminated, drop_contaminated, matches, tiles


def brute(a, b, least):
    """Greedy string tiling as published: rescan for the longest unmarked match until it is too short."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        ma[i : i + k] = [True] * k
        mb[j : j + k] = [True] * k
        out.append((i, j, k))


def test_against_rescanning():
    r = random.Random(4)
    for t in range(150):
        v = 1 + t % 4
        a = [r.randrange(v) for _ in range(r.randrange(0, 18))]
        b = [r.randrange(v) for _ in range(r.randrange(0, 30))]
        assert tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute(a, b, 3), (a, b)


def test_repetitive_texts_take_linear_room():
    item, text = np.full(1000, 7, np.uint64), np.full(50_000, 7, np.uint64)
    tracemalloc.start()
    assert tiles(item, text, 5) == [(0, 0, 1000)]
    item[::100] = np.arange(100, 110)  # the same words, cut at ten places
    assert sum(n for _, _, n in tiles(item, text, 5)) == 990
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_reordered_and_clean(spark):
    w = [f"word{i}" for i in range(40)]
    swapped = " ".join(["Intro,", *w[20:40], "and", *w[:20], "end."]).upper()
    rows = [(1, " ".join(w)), (2, swapped), (3, " ".join(w[:10])), (4, "nothing of it"), (5, None), (6, ""), (1, " ".join(w)), (None, swapped), (7, "x " * 50_000 + " ".join(w))]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(9, " ".join(w), 0), (10, None, 0), (11, "", 0), (12, "three odd words", 0)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["coverage"]) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 9, 1.0), (1, 9, 1.0), (2, 9, 1.0), (7, 9, 1.0), (None, 9, 1.0)], key=str)
    assert sorted((r["doc_id"] for r in drop_contaminated(docs, bench).collect()), key=str) == sorted([3, 4, 5, 6], key=str)
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_each_row_has_its_own_verdict(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage, 1), (1, "clean text of id one", 2), (None, passage, 3), (None, "clean", 4), (1, None, 5)], "doc_id long, text string, __bad int")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert sorted(r["__bad"] for r in drop_contaminated(docs, bench).collect()) == [2, 4, 5]


def test_short_items_match_whole_texts_only(spark):
    docs = spark.createDataFrame([(1, "Yes."), (2, "yes and no"), (3, "yes " * 9), (4, "no, yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "No yes"), (3, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()) == [(1, 1), (4, 2)]
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [2, 3]


def test_coverage_filter_loses_nothing(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in matches(docs, bench).where("2 * tiled_words >= item_words").collect())
    assert sorted(tuple(r)[:6] for r in contaminated(docs, bench).collect()) == want and want


def test_slices_give_the_same(spark, sf, monkeypatch):
    import millrace.llm.tiling as tl

    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, matches(docs, bench).collect()))
    kept = sorted(map(tuple, drop_contaminated(docs, bench).select("doc_id").collect()))
    monkeypatch.setattr(tl, "SLICE_WORDS", 600)
    assert sorted(map(tuple, matches(docs, bench).collect())) == whole and whole
    assert sorted(map(tuple, drop_contaminated(docs, bench).select("doc_id").collect())) == kept and kept
