import random
import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.occurrence import divide_skip, jaccard_components, keep_one
from millrace.llm.wordhash import hash_words, shingle_sets


def words(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both) and rows[i][0] is not None and rows[j][0] is not None:
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, k, num, den):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_shingles string, root int")
    return sorted(map(tuple, jaccard_components(df.repartition(3), words=k, num=num, den=den).collect()), key=str)


def test_against_all_pairs(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "Ab", "aB"]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one"), (1006, "one two three four five six")]
    rows += [(1006, "one two three four five six"), (None, "one two three four five six")]
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([5, 12, 40, 90]))]
        for c in range(r.choice([1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((g * 10 + c, r.choice([" ", "\n", "  "]).join(t)))
    passage = " ".join(r.choice(vocab) for _ in range(50))
    rows += [(500 + i, passage + " " + " ".join(r.choice(vocab) for _ in range(60))) for i in range(40)]
    for k, num, den in ((4, 85, 100), (5, 8, 10)):
        assert run(spark, rows, k, num, den) == brute(rows, k, num, den)


def test_large_group_in_blocks(spark, monkeypatch):
    import millrace.llm.occurrence as occ

    r = random.Random(2)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(i % 6):
            t[r.randrange(80)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(occ, "BLOCK_ELEMENTS", 900)
    monkeypatch.setattr(occ, "PAIRED", 10)
    monkeypatch.setattr(occ, "LIST_ROWS", 50)
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_tasks_of_a_large_enclosure(spark, monkeypatch):
    """Sets that may be partners meet, and a chain through many sizes doesn't send every set to every block."""
    import millrace.llm.occurrence as occ

    r = random.Random(4)
    sizes = [int(10 ** r.uniform(1, 4)) for _ in range(300)] + [100, 117, 118, 85, 7225, 8500, 10000]
    rows = [(i, i, n, 1) for i, n in enumerate(sizes)] + [(1000 + i, 1000 + i, 50, 2) for i in range(4)]
    monkeypatch.setattr(occ, "BLOCK_ELEMENTS", sum(sizes) // 60)
    sent = occ._tasks(spark.createDataFrame(rows, "set_key long, rep long, n long, root long"), 85, 100).collect()
    tasks = {}
    for t in sent:
        tasks.setdefault(t[2:], set()).add(t["set_key"])
    met = {(a, b) for keys in tasks.values() for a in keys for b in keys}
    for i, n in enumerate(sizes):
        assert all((i, j) in met for j, m in enumerate(sizes) if 85 * max(n, m) <= 100 * min(n, m))
    assert [k for t, k in tasks.items() if t[0] == 2] == [{1000, 1001, 1002, 1003}]
    assert sum(rows[t["set_key"]][2] for t in sent if t["root"] == 1) < 20 * sum(sizes)  # with all pairs of blocks: 60 times


def test_texts_that_stay_are_not_shuffled(spark):
    r = random.Random(8)
    texts = [" ".join(str(r.random()) for _ in range(400)) for _ in range(300)]
    texts += texts[:6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df = spark.createDataFrame(df.collect(), df.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def written():
        time.sleep(1)
        return sum(e.totalShuffleWrite() for e in seq(spark.sparkContext._jsc.sc().statusStore().executorList(True)))

    def seq(x):
        return [x.apply(i) for i in range(x.size())]

    try:
        kept = keep_one(df)
        at = written()
        assert sorted(r["text"] for r in kept.collect()) == sorted(texts[:300])
        assert written() - at < 0.2 * sum(map(len, texts)) * 0.5  # of digits, a little under half is left when compressed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def candidates(lists, paired, list_rows, batch_rows):
    import millrace.llm.occurrence as occ

    rows = [(h, k, 20 + k % 4, 5) for h, keys in enumerate(lists) for k in sorted(keys, key=lambda k: (k % 4, k))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + batch_rows]), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["h", "set_key", "n", "last"]) for i in range(0, len(rows), batch_rows)]
    before = occ.PAIRED, occ.LIST_ROWS
    occ.PAIRED, occ.LIST_ROWS = paired, list_rows
    try:
        return sorted(r for b in occ._candidates(85, 100)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns)))
    finally:
        occ.PAIRED, occ.LIST_ROWS = before


def test_a_long_list_ends_in_a_chunk_that_ends_in_another():
    # 10 sets share shingle 0; its last two come in one chunk with shingle 1 and the beginning of the long list of shingle 2
    lists = [range(0, 40, 4), (0, 36), range(0, 48, 4)]
    got = candidates(lists, 3, 8, 8)
    assert [r for r in got if r[2] == 0] == sorted([*((k, k + 4, 0) for k in range(0, 36, 4)), *((k, k + 4, 0) for k in range(0, 44, 4))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=14), min_size=1, max_size=8), st.integers(2, 5), st.integers(1, 12), st.integers(1, 6))
def test_candidates_do_not_depend_on_chunks(lists, paired, list_rows, batch_rows):
    assert candidates(lists, paired, list_rows, batch_rows) == candidates(lists, paired, 10**6, batch_rows)


def test_large_ids_beside_null_ids(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(2**53 + 1, " ".join(base)), (None, " ".join(base)), (2**53 + 3, " ".join([*base, "x"])), (2**62 + 1, " ".join([*base, "y", "z"])), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == brute(rows, 5, 8, 10)


def test_empty_and_kept(spark):
    assert run(spark, [], 4, 85, 100) == []
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (7, "z"), (8, None), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one(df).collect()), key=str) == sorted([(3, "a b c d e f g"), (7, "z"), (8, None), (None, "q")], key=str)


def test_one_row_of_a_group_is_kept_whatever_its_ids(spark):
    a, c = "a b c d e f g", "t u v w x y z"
    rows = [(2, a), (5, a), (5, c), (None, a), (None, a), (None, c), (None, None), (None, None), (5, "")]
    df = spark.createDataFrame([(*r, i, "q", 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, row long, __again string, __lead int, set_key int").repartition(3)
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["text"] for r in got.collect()), key=str) == sorted([a, c, None, None, ""], key=str)
    assert keep_one(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té€\x0b\xa0", max_size=40), min_size=1, max_size=6))
def test_word_hashes(texts):
    h, at = hash_words([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert len(w) == at[i + 1] - at[i]
        for x, y in zip(w, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_divide_skip_is_exact():
    r = random.Random(1)
    for _ in range(30):
        base = r.sample(range(1000), 60)
        texts = [" ".join(str(x if r.random() > 0.04 else r.randrange(1000)) for x in base) for _ in range(12)]
        sets = shingle_sets([t.encode() for t in texts], 2)
        got = divide_skip(sets, 8, 10)
        links = {(i, j) for i in range(12) for j in range(12) if 10 * len(a := set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j])) and a}
        root = list(range(12))
        for _ in range(12):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        assert got.tolist() == root
