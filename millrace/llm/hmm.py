"""Hidden Markov language model over the words of a corpus.

A text is its words (A-Z lower-cased, split at ASCII white space), then one end token. A state emits one of
``SYMBOLS`` symbols; a symbol is a fixed hash of a word (the end token has its own), and within a symbol a word has
its add-one share of that symbol's training count, one share being kept for words never seen. So each word of the
corpus has its own probability, counted over all training texts, while the matrix that Baum-Welch trains has a fixed
size at any scale. The likelihood of a text is exact: scaled forward recursion over all of its tokens.

Training: a few rounds of Baum-Welch in the driver on ``seed_pieces`` pieces of texts (of least hash, from anywhere in a
text, each of at most ``SEED`` tokens and taken as a sequence of its own) give starting values only; then each of
``rounds`` rounds aggregates the expected counts of all training texts, whole, across partitions. A long text is run in
pieces side by side, with the forward and backward messages carried over each cut, so its counts are those of the whole.

Word counts meet texts without skew: words with at least N / 2**19 occurrences, of which there are at most 2**19, are
broadcast; all others are joined, and none of those holds more than that share of the rows.

Defined cases: a null text is empty (one end token); repeated rows are scored each; a null id is never held out; extra
columns are ignored; with no training text every symbol is as likely as any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import least_hashed, map_batches, save
from millrace.llm.wordhash import hash_words, text_slices

SYMBOL_BITS = 15
SYMBOLS = 1 << SYMBOL_BITS
END = np.uint64(0xFFFFFFFFFFFFFFFF)
END_SYMBOL = SYMBOLS - 1
#: Words with at least this share of all training tokens are broadcast.
COMMON_SHARE = 1 / (1 << 19)
#: Tokens of a piece that gives starting values, and of the pieces in which long texts are run.
SEED = 512
PIECE = 512
_RANGE = 1024  # symbols in a row of partial counts
LN10 = np.log(10.0)


def symbols_of(h: np.ndarray) -> np.ndarray:
    return np.where(h == END, END_SYMBOL, np.minimum(h >> np.uint64(64 - SYMBOL_BITS), np.uint64(END_SYMBOL - 1))).astype(np.uint16)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and where each text's tokens begin."""
    h, at = hash_words(texts)
    n = len(texts)
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))] = h
    return out, at + np.arange(n + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return word, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def give():
        word, n = _merge(parts)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, _, texts in text_slices(batch.column(0)):
            parts.append(np.unique(_tokens(texts)[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > 1_500_000:
                parts = [_merge(parts)]
                if len(parts[0][0]) > 700_000:
                    yield give()
                    parts = []
    if parts:
        yield give()


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (SYMBOLS, K): probability of each symbol by state


def initial(prior: np.ndarray, states: int, seed: int) -> Model:
    r = np.random.default_rng(seed)
    emit = prior[:, None] * r.uniform(0.2, 1.8, (len(prior), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as a matrix (time, sequence), with their lengths and order."""
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    grid = np.zeros((int(n.max(initial=0)), len(seqs)), np.uint16)
    for c, i in enumerate(order.tolist()):
        grid[: n[i], c] = seqs[i]
    return grid, n[order], order


def _products(pieces: list[np.ndarray], opens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's product of transition and emission matrices, scaled to a sum of 1, and the log of what it was scaled by.

    One that opens its text has no transition before its first symbol. Pieces are run side by side.
    """
    k = len(model.start)
    out, logs = np.empty((len(pieces), k, k)), np.empty(len(pieces))
    by_length = np.argsort([-len(p) for p in pieces], kind="stable")
    for g in range(0, len(pieces), 512):
        some = by_length[g : g + 512]
        grid, n, order = _padded([pieces[i] for i in some.tolist()])
        some = some[order]
        live = np.searchsorted(-n, -np.arange(len(grid)), side="left")
        first = opens[some]
        m = np.where(first[:, None, None], np.eye(k), model.move) * model.emit[grid[0]][:, None, :]
        log = np.zeros(len(some))
        for t in range(1, len(grid)):
            d = int(live[t])
            now = (m[:d].reshape(-1, k) @ model.move).reshape(d, k, k)
            now *= model.emit[grid[t, :d]][:, None, :]
            if t % 8 == 0:  # in eight steps no product leaves the range of doubles
                total = now.sum((1, 2))
                now /= total[:, None, None]
                log[:d] += np.log(total)
            m[:d] = now
        total = m.sum((1, 2))
        out[some], logs[some] = m / total[:, None, None], log + np.log(total)
    return out, logs


def _cut(seqs: list[np.ndarray], model: Model) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(which, pieces, their products, logs) of each sequence of over PIECE symbols; many sequences are run side by side."""
    held: list[tuple[int, list[np.ndarray]]] = []

    def give() -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        opens = np.concatenate([np.arange(len(parts)) == 0 for _, parts in held])
        products, logs = _products([x for _, parts in held for x in parts], opens, model)
        at = 0
        for i, parts in held:
            yield i, parts, products[at : at + len(parts)], logs[at : at + len(parts)]
            at += len(parts)

    for i, s in enumerate(seqs):
        if len(s) > PIECE:
            held.append((i, [s[lo : lo + PIECE] for lo in range(0, len(s), PIECE)]))
            if sum(len(parts) for _, parts in held) >= 2048:
                yield from give()
                held = []
    if held:
        yield from give()


def log_likelihood(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """The natural log of the probability of each symbol sequence (each of one symbol at least): scaled forward recursion.

    Of a sequence of over PIECE symbols, each piece's matrix product is found side by side with others', and the state
    shares pass through the products in order.
    """
    out = np.zeros(len(seqs))
    for i, _, products, logs in _cut(seqs, model):
        v = model.start
        for x, log in zip(products, logs.tolist()):
            v = v @ x
            out[i] += log + np.log(v.sum())
            v = v / v.sum()
    short = np.array([i for i, s in enumerate(seqs) if len(s) <= PIECE], int)
    short = short[np.argsort([-len(seqs[i]) for i in short.tolist()], kind="stable")] if len(short) else short
    for g in range(0, len(short), 512):
        some = short[g : g + 512]
        grid, n, order = _padded([seqs[i] for i in some.tolist()])
        live = np.searchsorted(-n, -np.arange(len(grid)), side="left")  # sequences longer than t
        alpha = np.tile(model.start, (len(some), 1))
        log = np.zeros(len(some))
        for t in range(len(grid)):
            d = int(live[t])
            a = alpha[:d] if t == 0 else alpha[:d] @ model.move
            a *= model.emit[grid[t, :d]]
            s = a.sum(1)
            a /= s[:, None]
            alpha[:d] = a
            log[:d] += np.log(s)
        out[some[order]] = log
    return out


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (K, SYMBOLS)


def _messages(products: np.ndarray, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From the products of a text's pieces: the state shares before each, and the backward values at the end of each."""
    before, after = [model.start], [np.ones(len(model.start))]
    for x in products[:-1]:
        v = before[-1] @ x
        before.append(v / v.sum())
    for x in products[:0:-1]:
        v = x @ after[-1]
        after.append(v / v.sum())
    return before, after[::-1]


def expected_counts(seqs: list[np.ndarray], model: Model) -> Counts:
    """Baum-Welch counts (forward-backward) of whole sequences; those over PIECE symbols are run in pieces side by side."""
    k = len(model.start)
    out = Counts(np.zeros(k), np.zeros((k, k)), np.zeros((k, SYMBOLS)))
    one = np.ones(k)
    # symbols, whether first, shares before, values after
    pieces = [(s, True, model.start, one) for s in seqs if 0 < len(s) <= PIECE]
    for _, parts, products, _ in _cut(seqs, model):
        before, after = _messages(products, model)
        pieces += [(x, i == 0, before[i], after[i]) for i, x in enumerate(parts)]
    pieces.sort(key=lambda p: -len(p[0]))
    for g in range(0, len(pieces), 256):
        group = pieces[g : g + 256]
        grid, n, order = _padded([p[0] for p in group])
        first = np.array([group[i][1] for i in order.tolist()])
        before, after = (np.array([group[i][c] for i in order.tolist()]) for c in (2, 3))
        live = np.searchsorted(-n, -np.arange(len(grid)), side="left")
        steps = len(grid)
        alphas, emits, scales = [], [], []
        a = np.where(first[:, None], before, before @ model.move)
        for t in range(steps):
            d = int(live[t])
            e = model.emit[grid[t, :d]]
            a = (a if t == 0 else a[:d] @ model.move) * e
            s = a.sum(1, keepdims=True)
            a = a / s
            alphas.append(a)
            emits.append(e)
            scales.append(s)
        beta = np.empty((0, k))
        gammas = []
        for t in range(steps - 1, -1, -1):
            done = len(beta)
            if done:
                back = (emits[t + 1] * beta) / scales[t + 1]
                out.move += (alphas[t][:done].T @ back) * model.move
            beta = after[: int(live[t])] / (alphas[t] * after[: int(live[t])]).sum(1, keepdims=True)  # of pieces that end here
            if done:
                beta[:done] = back @ model.move.T
            gammas.append(alphas[t] * beta)
        gammas.reverse()
        out.start += gammas[0][first].sum(0)
        back = (emits[0] * beta) / scales[0]
        out.move += (before[~first].T @ back[~first]) * model.move  # transitions over the cuts
        gamma = np.concatenate(gammas)
        flat = np.concatenate([grid[t, : int(live[t])] for t in range(steps)])
        for j in range(k):
            out.emit[j] += np.bincount(flat, gamma[:, j], SYMBOLS)
    return out


def maximise(c: Counts, prior: np.ndarray, weight: float = 200.0) -> Model:
    """New parameters from counts; every state keeps ``weight`` symbols' worth of the corpus distribution."""
    emit = c.emit + weight * prior
    move = c.move + 1.0
    start = c.start + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), np.ascontiguousarray((emit / emit.sum(1, keepdims=True)).T))


def _encode(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob_words, blob_counts = common.value
        words, counts = np.frombuffer(blob_words, np.uint64), np.frombuffer(blob_counts, np.int64)
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                h, at = _tokens(texts)
                spot = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                hit = words[spot] == h if len(words) else np.zeros(len(h), bool)
                known = np.concatenate(([0], np.cumsum(hit)))
                score = np.concatenate(([0.0], np.cumsum(np.where(hit, logs[spot], 0.0)))) if len(words) else np.zeros(len(h) + 1)
                rare = h[~hit].view(np.int64)
                rare_at = np.arange(len(h) + 1) - known
                sym = symbols_of(h)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, hi - lo),
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("held_out").slice(lo, hi - lo),
                        pa.array(np.diff(at)),
                        pa.array(np.diff(known[at])),
                        pa.array([float(score[b] - score[a]) for a, b in zip(at, at[1:])], pa.float64()),
                        pa.array([sym[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                        pa.ListArray.from_arrays(rare_at[at].astype(np.int32), rare),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "common_known", "common_log", "syms", "rare"],
                )

    return run


def _partial_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, held, size = shared.value, None, [], 0

        def add():
            nonlocal total
            c = expected_counts(held, model)
            if total is None:
                total = c
            else:
                total.start += c.start
                total.move += c.move
                total.emit += c.emit

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, np.uint16))
                size += len(held[-1])
                if size > 400_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        if total is not None:
            parts = [np.concatenate((total.start, total.move.ravel())), *(total.emit[:, i : i + _RANGE].ravel() for i in range(0, SYMBOLS, _RANGE))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["part", "sums"])

    return run


def _add_up(given: str):
    """Sums of the rows of each part, held as one array of doubles for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                x = np.frombuffer(sums, given).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

    return run


def _trained(train: DataFrame, model: Model, prior: np.ndarray, rounds: int) -> Model:
    """``rounds`` rounds of Baum-Welch over all rows of ``train`` (syms binary). Sums are made in two steps, so that no
    task gets a row of every other."""
    schema, states = "part int, sums binary", len(model.start)
    for _ in range(rounds):
        parts = map_batches(train.select("syms"), _partial_counts(train.sparkSession.sparkContext.broadcast(model)), schema)
        some = map_batches(parts.withColumn("salt", F.spark_partition_id() % 64).repartition("part", "salt").drop("salt"), _add_up("<f4"), schema)
        of = {r["part"]: np.frombuffer(r["sums"], np.float64) for r in map_batches(some.repartition("part"), _add_up("<f8"), schema).collect()}
        emit = np.concatenate([of[i].reshape(states, _RANGE) for i in range(SYMBOLS // _RANGE)], 1)
        model = maximise(Counts(of[-1][:states], of[-1][states:].reshape(states, states), emit), prior)
    return model


def _forward(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shared.value
        for batch in batches:
            seqs = [np.frombuffer(x, np.uint16) for x in batch.column("syms").to_pylist()]
            log = log_likelihood(seqs, model) / LN10
            spread = np.array([shares[s].sum() for s in seqs])
            keep = batch.select(["row", "doc_id", "held_out", "n_tokens", "common_known", "common_log"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(log - spread)], [*keep.schema.names, "hidden"])

    return run


def score_texts(docs: DataFrame, *, states: int = 8, rounds: int = 2, seed_pieces: int = 600, seed_rounds: int = 12, seed: int = 7, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows that aren't held out and scores all.

    held_out: a boolean column; by default the rows with crc32(id as text) mod 7 = 2.
    Returns (doc_id, held_out, n_tokens, n_known, train_tokens long, base_score, score double): log10 probabilities
    under the add-one unigram model and under the hidden Markov model.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 7 == 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    counts = save(map_batches(rows.where(~F.col("held_out")).select("text"), _count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"])
    symbol = F.when(F.col("word") == -1, END_SYMBOL).otherwise(F.least(F.shiftrightunsigned("word", 64 - SYMBOL_BITS), F.lit(END_SYMBOL - 1)))
    by_symbol = counts.groupBy(symbol.cast("int").alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    sizes = np.ones(SYMBOLS)  # one share of each symbol is for words never seen; the end token is always seen
    sizes[by_symbol["symbol"].to_numpy(int)] += (by_symbol["n"] + by_symbol["v"]).to_numpy(float)
    prior = sizes / sizes.sum()
    shares = np.log10(sizes)
    least = max(2, int(np.ceil(n_all * COMMON_SHARE)))
    common = counts.where(F.col("n") >= least).toPandas()
    word = common["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    shared = spark.sparkContext.broadcast((word[order].tobytes(), common["n"].to_numpy(np.int64)[order].tobytes()))

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    coded = save(map_batches(numbered, _encode(shared), "row long, doc_id long, held_out boolean, n_tokens long, common_known long, common_log double, syms binary, rare array<long>"), "coded")
    train = coded.where(~F.col("held_out"))

    step = 2 * SEED  # bytes
    n_pieces = F.ceil(F.octet_length("syms") / F.lit(step)).cast("int")  # one at least: a text has its end token
    cut = F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda i: F.substring("syms", i * step + 1, F.lit(step)))
    pieces = train.select("doc_id", "row", F.posexplode(cut).alias("nth", "syms")).select("syms", F.xxhash64("doc_id", "row", "nth").alias("o"))
    known = train.agg(F.sum(n_pieces).alias("n")).first()["n"] or 0
    first = least_hashed(pieces, "o", seed_pieces, known).select("syms").collect()
    model = initial(prior, states, seed)
    sample = [np.frombuffer(r["syms"], np.uint16) for r in first]
    for _ in range(seed_rounds if sample else 0):
        model = maximise(expected_counts(sample, model), prior, 20.0)
    model = _trained(train, model, prior, rounds if sample else 0)

    hidden = coded.select("row", "doc_id", "held_out", "n_tokens", "common_known", "common_log", "syms")
    hidden = map_batches(hidden, _forward(spark.sparkContext.broadcast((model, shares))), "row long, doc_id long, held_out boolean, n_tokens long, common_known long, common_log double, hidden double")
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("n") < least), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    logs = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    return hidden.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("hidden") + logs).alias("score"),
    )


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2
