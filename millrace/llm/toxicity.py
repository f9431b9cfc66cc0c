"""Toxicity by a classifier chain.

Categories are predicted in order; each category's logistic model sees the text's words and the probabilities that
earlier models gave, and is trained with out-of-fold values of those, so that it learns how far to trust them. The
models are fitted on a bounded sample of labelled texts (``POSITIVE`` with the last category and ``NEGATIVE`` without,
by least id hash). Words are counted over the sample on executors; the driver gets at most ``WORDS`` of a category, and
of each sampled text the chosen words that it holds. Every text is scored as a whole.

Defined cases: a null or empty text has only the models' constants; labels with a null count as unlabelled, and
repeated labels of an id with differing values as well; of an id with several texts, the one of least hash is fitted;
with no labelled text, or of one kind only, probabilities are the smoothed share of that kind; repeated rows are scored
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import discard, least_hashed, map_batches, save
from millrace.llm.wordhash import LETTERS, hash_words

#: The most labelled texts that are fitted, with and without the last category.
POSITIVE, NEGATIVE = 3000, 5000
#: Words kept for a category, and the least number of sample texts that hold a word.
WORDS, LEAST_TEXTS = 1000, 4
#: And the least lower bound of a word's absolute log odds ratio.
LEAST_ODDS = 0.25
FOLDS = 3
#: Words that are longer than so many bytes also count by their beginning: it is common to a word's inflected forms.
HEAD = 4


def _words(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct words (runs of letters, lower-cased) and beginnings of words of each text as sorted hashes."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        blobs, size = [], 0
        while i < len(texts) and (not blobs or size < 1 << 20):
            blobs.append((texts[i] or "").lower().encode("utf-8", "replace"))
            size += len(blobs[-1])
            i += 1
        h, at, heads = hash_words(blobs, LETTERS, HEAD)
        for a, b in zip(at, at[1:]):
            both = np.unique(np.concatenate((h[a:b], heads[a:b])))
            out.append(both[both != 0])
    return out


def _logistic(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights of ``width`` words, the dense columns and a constant: L2-regularised, classes weighed alike.

    Newton steps, each solved by conjugate gradients, halved while the loss would grow.
    """
    idx = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    extra = np.column_stack((dense, np.ones(len(rows))))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(width + extra.shape[1], ridge)
    penalty[-1] = 1e-6
    times = lambda v: np.bincount(of, v[idx], len(rows)) + extra @ v[width:]
    back = lambda r: np.concatenate((np.bincount(idx, r[of], width), extra.T @ r))
    loss = lambda w, z: (weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2
    w = np.zeros(len(penalty))
    z = times(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = back(weight * (p - y)) + penalty * w
        if np.abs(g).max() < 1e-3:
            break
        curve = weight * p * (1 - p)
        scale = 1 / (np.concatenate((np.bincount(idx, curve[of], width), (extra * extra).T @ curve)) + penalty)
        step, rest = np.zeros(len(w)), -g
        d = scale * rest
        least, now = (g * scale * g).sum() * 1e-6, (rest * d).sum()
        for _ in range(60):
            if now <= least:
                break
            h = back(curve * times(d)) + penalty * d
            t = now / (d @ h)
            step, rest = step + t * d, rest - t * h
            last, now = now, (rest * scale * rest).sum()
            d = scale * rest + now / last * d
        before, size = loss(w, z), 1.0
        while size > 1e-4 and loss(w + size * step, new := times(w + size * step)) > before:
            size /= 2
        w, z = w + size * step, new
    return w


@dataclass
class Chain:
    names: list[str]
    words: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # for each category: words, earlier categories, constant

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log odds (text, category), of rows of positions in ``words``."""
        out = np.zeros((len(rows), len(self.names)))
        earlier = np.zeros((len(rows), len(self.names)))
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        idx = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        for c, w in enumerate(self.weights):
            z = np.bincount(of, w[idx], len(rows)) + earlier[:, :c] @ w[len(self.words) : -1] + w[-1]
            out[:, c] = np.clip(z, -12, 12)
            earlier[:, c] = probability(out[:, c])
        return out

    def place(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(self.words, np.intersect1d(r, self.words, assume_unique=True)) for r in rows]


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def fit_chain(names: list[str], words: np.ndarray, rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Chain:
    """rows: positions in ``words`` of each text; y: (text, category) of 0 and 1; fold: 0 to FOLDS - 1."""
    chain = Chain(names, words, [])
    if not len(rows):
        chain.weights = [np.zeros(len(words) + c + 1) for c in range(len(names))]
        return chain
    width = len(words)
    earlier = np.empty((len(rows), 0))
    for c in range(y.shape[1]):
        target = y[:, c].astype(float)
        constant = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
        one_kind = target.min() == target.max()
        fixed = np.zeros(width + c + 1)
        fixed[-1] = constant
        chain.weights.append(fixed if one_kind else _logistic(rows, earlier, target, width))
        out = np.full(len(rows), constant)
        for f in range(FOLDS if not one_kind else 0):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(outside) and len(inside) and target[inside].min() != target[inside].max():
                w = _logistic([rows[i] for i in inside], earlier[inside], target[inside], width)
                out[outside] = [w[rows[i]].sum() for i in outside] + earlier[outside] @ w[width:-1] + w[-1]
        earlier = np.column_stack((earlier, probability(np.clip(out, -12, 12))))
    return chain


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = _words(batch.column("text").to_pylist())
        keep = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([w.tobytes() for w in words], pa.binary())], [*batch.schema.names[:-1], "words"])


def _word_counts(categories: int):
    """For each word of a batch: how many texts hold it, and how many of those are in each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            word, inverse = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_inverse=True)
            of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            counts = [np.bincount(inverse, minlength=len(word))]
            for c in range(categories):
                counts.append(np.bincount(inverse[batch.column(f"y{c}").to_numpy()[of] == 1], minlength=len(word)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(n.astype(np.int64)) for n in counts)], ["word", "df", *(f"p{c}" for c in range(categories))])

    return run


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain([], np.frombuffer(shared.value, np.uint64), [])
        for batch in batches:
            at = chain.place([np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.astype(np.int32).tobytes() for x in at], pa.binary())], [*batch.schema.names[:-1], "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]], *, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: (name, boolean column over ``labels``) in the order of the chain; the last one decides the sample."""
    names = [n for n, _ in categories]
    ys = [f"y{i}" for i in range(len(names))]
    known = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(y) for y, (_, c) in zip(ys, categories))).dropna()
    known = known.groupBy("id").agg(*(F.min(y).alias(y) for y in ys), F.max(F.struct(*ys)).alias("top"), F.min(F.struct(*ys)).alias("low")).where(F.col("top") == F.col("low"))
    known = save(known.select("id", *ys, F.xxhash64("id").alias("o")), "labels")
    total = {r[0]: r[1] for r in known.groupBy(ys[-1]).count().collect()}
    pick = lambda v, n: least_hashed(known.where(F.col(ys[-1]) == v), "o", n, total.get(v, 0))
    sample = pick(1, POSITIVE).unionByName(pick(0, NEGATIVE))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most POSITIVE + NEGATIVE short rows: a proven bound for the broadcast; one text of an id leaves each task
    found = texts.join(F.broadcast(sample), "id").groupBy("id", *ys, "o").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fields = "id long, " + "".join(f"{y} int, " for y in ys) + "o long"
    found = save(map_batches(found.select("id", *ys, "o", "text"), _features, f"{fields}, words binary"), "features")

    size = found.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    counts = map_batches(found, _word_counts(len(ys)), "word long, df long" + "".join(f", p{c} long" for c in range(len(ys)))).groupBy("word")
    counts = save(counts.agg(F.sum("df").alias("df"), *(F.sum(f"p{c}").alias(f"p{c}") for c in range(len(ys)))).where(F.col("df") >= LEAST_TEXTS), "counts")
    chosen: set[int] = set()
    for c, y in enumerate(ys):
        p, rest, n1 = F.col(f"p{c}") + 0.5, F.col("df") - F.col(f"p{c}") + 0.5, size[y] or 0
        # the lower bound of each word's absolute log odds ratio
        low = F.abs(F.log(p / (n1 + 1) / (rest / (size["n"] - n1 + 1)))) - 2 * F.sqrt(1 / p + 1 / rest)
        chosen |= {r["word"] for r in counts.select("word", low.alias("low")).where(F.col("low") > LEAST_ODDS).orderBy(F.desc("low"), "word").limit(WORDS).collect()}
    words = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(words.tobytes())
    got = map_batches(found, _placed(shared), f"{fields}, at binary").toArrow().sort_by([("o", "ascending"), ("id", "ascending")])
    discard(known, found, counts)
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("at")]
    y = np.column_stack([got.column(c).to_numpy() for c in ys]).astype(int)
    return fit_chain(names, words, rows, y, got.column("o").to_numpy() % FOLDS)


def score(docs: DataFrame, chain: Chain, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, p_<category> double, ..., toxic boolean): toxic if the last category reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = probability(model.odds(model.place(_words(batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c].copy()) for c in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], ["doc_id", *(f"p_{n}" for n in model.names), "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + "".join(f"p_{n} double, " for n in chain.names) + "toxic boolean")


def drop_toxic(docs: DataFrame, chain: Chain, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text isn't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            odds = model.odds(model.place(_words(batch.column(column).to_pylist())))
            yield batch.filter(pa.array(odds[:, -1] < limit))

    return map_batches(docs, run, docs.schema)


#: Of the ``labels`` table: low quality comes first in the chain, toxicity last.
def label_categories() -> list[tuple[str, Column]]:
    return [("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
