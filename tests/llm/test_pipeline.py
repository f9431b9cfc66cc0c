from collections import defaultdict

import corpus_pipeline as cp
from millrace.llm import pii, tiling, toxicity
from millrace.llm.queries import QUERIES, table
from tests.llm.test_occurrence import brute as groups
from tests.llm.test_packing import check_pieces


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = (before, docs)

    before, after = kept["toxicity"]
    flagged = {r["doc_id"] for r in toxicity.score(before, toxicity.train(before, table(spark, sf, "labels"), toxicity.label_categories())).where("toxic").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - flagged and flagged

    before, after = kept["near duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {c for _, _, c in groups(rows, 5, 8, 10)}

    before, after = kept["decontamination"]
    bad = {r["doc_id"] for r in tiling.matches(before, table(spark, sf, "benchmark")).where("2 * tiled_words >= item_words").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad and bad

    before, after = kept["personal data"]
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert masked == {r["doc_id"]: (t := pii.mask_text(r["text"]), len(t)) for r in before.collect()}

    before, after = kept["packing"]
    check_pieces([(r["doc_id"], r["text"]) for r in before.collect()], after.collect())
    by = defaultdict(int)
    for r in after.collect():
        by[r["doc_id"]] += r["length"]
    assert sorted(by) == sorted(r["doc_id"] for r in before.collect())


def odd_documents(spark, sf):
    """Null ids, repeated ids and rows, null, blank and very long texts, and columns whose names the operators use."""
    benchmark = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    prose = " ".join(f"plain{i}" for i in range(40))
    texts = [None, None, "", " \n", prose, prose, prose + " again", "word " * 60_000, f"before {benchmark} after", "mail jane.doe@example.com or jane at example dot com", "yes"]
    rows = [(d, t) for t in texts for d in (7, None, 7)] + [(100 + i, t) for i, t in enumerate(texts)]
    rows = [(d, t, "en", "s", len(t or ""), i, "x", 1, b"", 0.5, True) for i, (d, t) in enumerate(rows)]
    extra = "nth int, set_key string, root int, ids binary, p_toxic double, toxic boolean"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {extra}").repartition(3), benchmark


def test_stages_on_odd_documents(spark, sf):
    docs, benchmark = odd_documents(spark, sf)
    rows = {r["nth"]: r for r in docs.collect()}
    known = table(spark, sf, "documents")
    chain = toxicity.train(known, table(spark, sf, "labels"), toxicity.label_categories())
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {r["nth"] for r in kept.collect()} <= set(rows)
    assert {rows[r["nth"]]["text"] for r in kept.collect()} >= {None, "", "yes"}

    once = cp.keep_one_of_each_group(spark, docs, sf)
    assert once.columns == docs.columns
    left = [r["text"] for r in once.collect()]
    words = [t for t in left if t and t.strip()]
    assert len(words) == len(set(words)) and {t[:5] for t in words} == {"plain", "word ", "befor", "mail ", "yes"}
    assert len(left) - len(words) == 16  # texts without words link with nothing

    clean = cp.decontaminate(spark, docs, sf)
    assert clean.columns == docs.columns
    assert {r["nth"] for r in clean.collect()} == {i for i, r in rows.items() if not (r["text"] and benchmark in r["text"])}

    masked = cp.mask_pii(spark, docs, sf)
    assert masked.columns == docs.columns
    got = {r["nth"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: None if r["text"] is None else pii.mask_text(r["text"]) for i, r in rows.items()}
    assert all(t is None or n == len(t) for t, n in got.values()) and not any(t and "jane" in t for t, _ in got.values())

    check_pieces([(r["doc_id"], r["text"]) for r in rows.values()], cp.pack(spark, docs, sf).collect())


def test_stages_on_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, sf)
        assert got.collect() == [] and (name == "packing" or got.columns == docs.columns)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
