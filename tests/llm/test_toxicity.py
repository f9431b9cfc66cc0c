import math

import numpy as np

from millrace.llm import toxicity as tx


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("doc_id % 5 = 0")
    chain = tx.train(docs, labels.where("doc_id % 5 <> 0"), tx.label_categories())
    got = held.select("doc_id", "toxic").toPandas().merge(tx.score(held, chain).toPandas(), on="doc_id", suffixes=("_true", ""))
    hit = (got["toxic"] == (got["toxic_true"] == 1)).mean()
    found = got[got["toxic_true"] == 1]["toxic"].mean()
    false = got[got["toxic_true"] == 0]["toxic"].mean()
    assert hit > 0.97 and found > 0.9 and false < 0.02, (hit, found, false)
    kept = tx.drop_toxic(held.select(docs.columns), chain)
    assert kept.count() == int((~got["toxic"]).sum()) and kept.columns == docs.columns


def newton(x, y, ridge):
    """The same weighted, penalised logistic loss, solved by Newton's method on a dense matrix."""
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(h, g)
    return w


def plain_chain(x, y, fold, new):
    """Odds of ``new`` rows by a chain of dense models, each fed with the out-of-fold probabilities of those before."""
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    earlier, fed, out = np.empty((len(x), 0)), np.empty((len(new), 0)), []
    for c in range(y.shape[1]):
        one = np.ones((len(x), 1))
        full = np.hstack((x, earlier, one))
        w = newton(full, y[:, c], 1.0)
        z = np.hstack((new, fed, np.ones((len(new), 1)))) @ w
        out.append(z)
        held = np.empty(len(x))
        for f in range(tx.FOLDS):
            inside = fold != f
            held[~inside] = full[~inside] @ newton(full[inside], y[inside, c], 1.0)
        earlier, fed = np.column_stack((earlier, p(held))), np.column_stack((fed, p(z)))
    return np.column_stack(out)


def test_chain_against_a_plain_one():
    r = np.random.default_rng(0)
    rows = [np.unique(r.choice(40, 12)) for _ in range(300)]
    first = np.array([int(3 in x or 17 in x) for x in rows])
    second = first & np.array([int(len(x) % 2) for x in rows])
    y, fold = np.column_stack((first, second)), np.arange(300) % 3
    chain = tx.fit_chain(["a", "b"], np.arange(40, dtype=np.uint64), rows, y, fold)
    x = np.zeros((300, 40))
    for i, row in enumerate(rows):
        x[i, row] = 1
    want = plain_chain(x, y, fold, x)
    assert np.abs(tx.probability(chain.odds(rows)) - tx.probability(want)).max() < 0.01
    assert chain.weights[1][40] > 0  # the first category speaks for the second


def test_scores_against_a_plain_chain(spark, sf):
    """Words, folds, models and scores from texts and labels, all by plain loops."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = tx.train(docs, labels, tx.label_categories())
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in tx.score(docs, chain).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = labels.selectExpr("doc_id", "int(quality = 0) a", "int(toxic = 1) b", "xxhash64(doc_id) o").where("a is not null and b is not null").collect()
    known = sorted((r for r in known if r["doc_id"] in text), key=lambda r: (r["o"], r["doc_id"]))
    assert sum(r["b"] for r in known) <= tx.POSITIVE and len(known) <= tx.NEGATIVE  # all of them are fitted
    sets = [set(tx._words([text[r["doc_id"]]])[0].tolist()) for r in known]
    y = np.array([[r["a"], r["b"]] for r in known])
    n, chosen = len(known), set()
    for c in range(2):
        low = {}
        for w in set().union(*sets):
            hold = [i for i, s in enumerate(sets) if w in s]
            p = sum(y[i, c] for i in hold)
            if len(hold) >= tx.LEAST_TEXTS:
                a, b = (p + 0.5) / (y[:, c].sum() + 1), (len(hold) - p + 0.5) / (n - y[:, c].sum() + 1)
                low[w] = abs(math.log(a / b)) - 2 * math.sqrt(1 / (p + 0.5) + 1 / (len(hold) - p + 0.5))
        chosen |= set(sorted((w for w in low if low[w] > tx.LEAST_ODDS), key=lambda w: -low[w])[: tx.WORDS])
    words = sorted(chosen)
    assert words == chain.words.tolist()
    ids = sorted(text)[:200]
    matrix = lambda of: np.array([[w in s for w in words] for s in of], float).reshape(len(of), -1)
    want = plain_chain(matrix(sets), y, np.array([r["o"] for r in known]) % tx.FOLDS, matrix([set(tx._words([text[d]])[0].tolist()) for d in ids]))
    want = 1 / (1 + np.exp(-np.clip(want, -12, 12)))
    assert np.abs(np.array([got[d] for d in ids]) - want).max() < 0.02


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, 0.5), (2, "x" * 300_000, 0.5), (2, "", 0.5), (None, "scum", 0.5)], "doc_id long, text string, p_toxic double")
    chain = tx.train(docs, labels, tx.label_categories())
    out = tx.score(docs, chain).collect()
    assert len(out) == 4 and out[0].__fields__ == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    assert tx.score(docs.limit(0), tx.train(docs.limit(0), labels, tx.label_categories())).collect() == []
    # one label of one kind: every probability is the smoothed share of 1.5 in 2
    assert tx.drop_toxic(docs, chain).collect() == []
    assert sorted((r["doc_id"] for r in tx.drop_toxic(docs, chain, threshold=0.9).collect()), key=str) == sorted([1, 2, 2, None], key=str)
    assert tx.drop_toxic(docs.limit(0), chain).collect() == [] and tx.drop_toxic(docs, chain).columns == docs.columns


def test_repeated_ids_give_one_text_each(spark):
    words = ["alpha beta", "gamma delta", "alpha gamma", "beta delta"]
    docs = spark.createDataFrame([(i % 40, f"{words[i % 4]} {i // 400}", 0) for i in range(4000)], "doc_id long, text string, y0 int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    chain = tx.train(docs, labels, tx.label_categories())
    assert len(chain.weights) == 2 and tx.score(docs, chain).count() == 4000
