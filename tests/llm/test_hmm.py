import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import hmm


def toks(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def base(rows):
    c = Counter(t for d, x in rows if d is None or not hmm.crc_held_out(d) for t in toks(x))
    n, v = sum(c.values()), len(c)
    return sorted(((d, d is not None and hmm.crc_held_out(d), len(toks(x)), sum(c[t] > 0 for t in toks(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks(x)), 6)) for d, x in rows), key=str)


def test_base_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = hmm.score_texts(docs).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((*r[:5], round(r[5], 6)) for r in out), key=str) == base(rows)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "A a\tb"), (None, "a c"), (9, "x " * 3000)]
    df = spark.createDataFrame([(d, t, 0, "w") for d, t in rows], "doc_id long, text string, row int, word string")
    out = hmm.score_texts(df).collect()
    assert sorted(((*r[:5], round(r[5], 6)) for r in out), key=str) == base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in out)
    assert hmm.score_texts(df.limit(0)).collect() == []


def tiny(k=3, seed=0):
    r = np.random.default_rng(seed)
    emit = r.dirichlet(np.ones(hmm.SYMBOLS) * 0.01, k).T + 1e-9
    return hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), np.ascontiguousarray(emit / emit.sum(0)))


def test_forward_is_the_sum_over_all_paths():
    m = tiny()
    seqs = [np.random.default_rng(i).integers(0, hmm.SYMBOLS, i + 1).astype(np.uint16) for i in range(6)]
    for s, got in zip(seqs, hmm.log_likelihood(seqs, m)):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-9)


def test_pieces_equal_plain_recursion():
    m = tiny(4, 3)
    s = np.random.default_rng(1).integers(0, hmm.SYMBOLS, 5000).astype(np.uint16)
    v, log = m.start * m.emit[s[0]], 0.0
    for i, x in enumerate(s.tolist()):
        v = v if i == 0 else (v @ m.move) * m.emit[x]
        log += math.log(v.sum())
        v = v / v.sum()
    assert hmm.log_likelihood([s[:3], s, s[:513]], m)[1] == pytest.approx(log, rel=1e-10)


def plain_counts(seqs, m):
    """Forward-backward of each whole sequence by itself."""
    k = len(m.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm.SYMBOLS))
    for s in seqs:
        alpha, scale = [], []
        for t, x in enumerate(s.tolist()):
            a = (m.start if t == 0 else alpha[-1] @ m.move) * m.emit[x]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        beta = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            gamma = alpha[t] * beta
            emit[:, s[t]] += gamma
            if t:
                move += np.outer(alpha[t - 1], m.emit[s[t]] * beta / scale[t]) * m.move
                beta = m.move @ (m.emit[s[t]] * beta) / scale[t]
        start += gamma
    return start, move, emit


def test_counts_of_long_sequences_are_those_of_the_whole(monkeypatch):
    m = tiny(3, 2)
    r = np.random.default_rng(4)
    for piece, lengths in ((7, [1, 6, 7, 8, 14, 15, 50, 3]), (hmm.PIECE, [hmm.PIECE, 2 * hmm.PIECE + 13, 30])):
        monkeypatch.setattr(hmm, "PIECE", piece)
        seqs = [r.integers(0, 40, n).astype(np.uint16) for n in lengths]
        got = hmm.expected_counts(seqs, m)
        for have, want in zip((got.start, got.move, got.emit), plain_counts(seqs, m)):
            assert np.allclose(have, want, rtol=1e-8, atol=1e-9)


def test_whole_corpus_against_a_dictionary_model(spark, monkeypatch):
    """Training rounds and scores from the texts' words, by plain loops over a dictionary of words."""
    r = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)]
    texts = {d: " ".join(r.choice(vocab[:30] if d % 2 else vocab[20:], int(n))) for d, n in enumerate([*r.integers(1, 80, 50), 2600, 5000])}
    seen = {}

    def trained(train, model, prior, rounds, real=hmm._trained):
        seen["first"], seen["prior"], seen["last"] = model, prior, real(train, model, prior, rounds)
        return seen["last"]

    monkeypatch.setattr(hmm, "_trained", trained)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {x["doc_id"]: x for x in hmm.score_texts(df, states=3, rounds=2, seed_pieces=10).collect()}
    symbol = lambda t: hmm.END_SYMBOL if t is None else int(hmm.symbols_of(hmm.hash_words([t.encode()])[0])[0])
    coded = {d: np.array([symbol(t) for t in toks(x)], np.uint16) for d, x in texts.items()}
    kept = [s for d, s in coded.items() if not hmm.crc_held_out(d)]
    model = seen["first"]
    for _ in range(2):
        model = hmm.maximise(hmm.Counts(*plain_counts(kept, model)), seen["prior"])
    for have, want in zip((seen["last"].start, seen["last"].move, seen["last"].emit), (model.start, model.move, model.emit)):
        assert np.allclose(have, want, rtol=1e-4, atol=1e-9)
    count = Counter(t for d, x in texts.items() if not hmm.crc_held_out(d) for t in toks(x))
    size = Counter({symbol(None): 0})
    for t, n in count.items():
        size[symbol(t)] += n + 1
    for d, x in texts.items():
        v, log = None, 0.0
        for t in toks(x):
            s = symbol(t)
            share = (count[t] + 1) / (size[s] + 1)
            v = (seen["last"].start if v is None else v @ seen["last"].move) * seen["last"].emit[s] * share
            log += math.log10(v.sum())
            v = v / v.sum()
        assert out[d]["score"] == pytest.approx(log, rel=1e-6), d


def test_baum_welch_counts_and_progress():
    m = tiny(2, 5)
    s = np.array([4, 9, 4, 4], np.uint16)
    c = hmm.expected_counts([s], m)
    total, want = 0.0, np.zeros((2, 2))
    for path in itertools.product(range(2), repeat=4):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        total += p
        for a, b in zip(path, path[1:]):
            want[a, b] += p
    assert np.allclose(c.move, want / total)
    assert c.emit.sum() == pytest.approx(4) and c.start.sum() == pytest.approx(1)
    seqs = [np.random.default_rng(i).choice([1, 2, 3] if i % 2 else [7, 8, 9], 40).astype(np.uint16) for i in range(30)]
    prior = np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS)
    model, last = hmm.initial(prior, 2, 1), -np.inf
    for _ in range(6):
        model = hmm.maximise(hmm.expected_counts(seqs, model), prior, 1e-3)
        now = hmm.log_likelihood(seqs, model).sum()
        assert now > last - 1.0
        last = now
