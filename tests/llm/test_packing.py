import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bestfit, costpack
from millrace.llm.wordids import ChunkTokenizer, word_tokenizer

TOK = Tokenizer.from_file(word_tokenizer())
ODD = ["a\x1cb c\x85d e", "Σας ΣΣ. aΣ", "é ́x", "<|endoftext|> a<|startoftext|>b", "don't WE'LL 12345 a1b2", "日本語 テキスト", "​ ﻿x", "İstanbul ﬁ ǅ", "😀😀 👩‍👩", "a b", "\x00 \x7f"]


def ids(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_chunks_equal_whole_texts(texts):
    got = ChunkTokenizer.at(word_tokenizer()).encode(texts, 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [ids(t) for t in texts]


def test_odd_texts(spark, sf):
    texts = ODD + [" ".join(ODD), None] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    got = ChunkTokenizer.at(word_tokenizer()).encode(texts, 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [ids(t) for t in texts]


def best_fit_scan(lengths, width):
    n, rooms, used = 0, [], 0
    rests = []
    for x in lengths:
        n += x // width
        if x % width:
            rests.append(x % width)
    for x in sorted(rests, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            r = min(fits)
            rooms.remove(r)
            rooms.append(r - x)
        else:
            rooms.append(width - x)
            used += 1
    return n + used


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 33))
def test_both_are_lossless_and_within_bounds(lengths, width):
    for fn in (bestfit.best_fit, costpack.balance):
        pieces = fn(lengths, width)
        of, seq = defaultdict(list), defaultdict(list)
        for item, start, n, s, offset in pieces:
            of[item].append((start, n))
            seq[s].append((offset, n))
        for spans, total in [*((of[i], x) for i, x in enumerate(lengths)), *((v, None) for v in seq.values())]:
            at = 0
            for a, n in sorted(spans):
                assert a == at and n > 0
                at += n
            assert at == total if total is not None else at <= width
        assert sorted(seq) == list(range(len(seq)))
        if fn is bestfit.best_fit:
            assert len(seq) == best_fit_scan(lengths, width)
        else:
            assert len(seq) <= -(-sum(lengths) // width)


def balance_scan(lengths, width):
    """The longest piece goes to the cheapest sequence that holds it; where none does, the emptiest takes what it can."""
    n = -(-sum(lengths) // width)
    left, cost, out = [width] * n, [0.0] * n, []
    pieces = [(x, i, 0) for i, x in enumerate(lengths) if x]
    while pieces:
        length, item, start = piece = min(pieces, key=lambda p: (-p[0], p[1], p[2]))
        pieces.remove(piece)
        if length > width:
            pieces += [(width, item, start), (length - width, item, start + width)]
            continue
        fits = [s for s in range(n) if left[s] >= length]
        s = min(fits, key=lambda s: (cost[s], s)) if fits else min(range(n), key=lambda s: (-left[s], s))
        take = min(length, left[s])
        if take < length:
            pieces.append((length - take, item, start + take))
        out.append((item, start, take, s, width - left[s]))
        left[s] -= take
        cost[s] += costpack.LINEAR * take + costpack.QUADRATIC * take * take
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40), st.integers(1, 33))
def test_balance_against_scanning(lengths, width):
    assert costpack.balance(lengths, width) == balance_scan(lengths, width)


def test_costs_are_balanced():
    r = random.Random(0)
    lengths = [r.choice([30, 100, 300, 900, 2000]) for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, s, _ in costpack.balance(lengths, 4096):
        cost[s] += 2048 * n + n * n
    even = sorted(cost.values())
    assert even[len(even) * 9 // 10] < 1.6 * even[len(even) // 10]


def check_pieces(rows, out):
    want = sorted(((d, len(ids(t))) for d, t in rows), key=str)
    by, seq = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0), key=str) == want
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(ids(t))
    for d, rs in by.items():
        have = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rs)
        if len(texts[d]) == 1:
            x, at = texts[d][0], 0
            for a, n, crc in have:
                assert a == at and zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()) == crc
                at += n
            assert at == len(x)
    for v in seq.values():
        at = 0
        for a, n in sorted(v):
            assert a == at
            at += n
        assert at <= 4096
    return len(seq)


def test_cost_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n = check_pieces(rows, costpack.pack(docs, word_tokenizer()).collect())
    assert n <= -(-sum(len(ids(t)) for _, t in rows) // 4096) + 1


EDGES = [(1, None), (1, None), (2, ""), (None, "a b"), (4, "word " * 9000), (5, "One  two\n\nthree")]


def test_edges(spark):
    df = spark.createDataFrame([(d, t, b"z", 1) for d, t in EDGES], "doc_id long, text string, ids binary, block int")
    check_pieces(EDGES, costpack.pack(df, word_tokenizer()).collect())
    assert costpack.pack(df.limit(0), word_tokenizer()).collect() == []
    assert bestfit.pack(df.limit(0), word_tokenizer()).collect() == []
    parts = defaultdict(list)
    for r in bestfit.pack(df, word_tokenizer(), width=1024).collect():
        x = np.frombuffer(r["input_ids"], "<u2")
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts[d].append((s, x[a:b].tolist()))
    whole = lambda t: [(i, p) for i, p in ((i, ids(t)[i : i + 1024]) for i in range(0, len(ids(t)), 1024))]
    assert {d: sorted(p) for d, p in parts.items()} == {d: sorted(q for e, t in EDGES if e == d for q in whole(t)) for d, _ in EDGES}


def test_matrices_give_back_every_document(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(300)
    df = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, (_, t) in enumerate(EDGES)], "doc_id long, text string"))
    bestfit.write(bestfit.pack(df, word_tokenizer(), width=512), f"{tmp_path}/packed")
    parts, tokens, n = defaultdict(list), 0, 0
    for r in spark.read.parquet(f"{tmp_path}/packed").collect():
        x, pos = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cut = r["cu_seqlens"]
        assert len(x) == len(pos) == 512 and cut[0] == 0 and not x[cut[-1] :].any()
        for d, s, a, b in zip(r["doc_ids"], r["starts"], cut, cut[1:]):
            parts[d].append((s, x[a:b].tolist()))
            assert pos[a:b].tolist() == list(range(b - a))
        tokens, n = tokens + cut[-1], n + 1
    for r in df.collect():
        assert sum((p for _, p in sorted(parts[r["doc_id"]])), []) == ids(r["text"])
    assert tokens > 0.97 * 512 * n
