"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own (k-means on a bounded
sample), and pairs of code words are the cells of a grid. Every vector lies in its nearest cell; as a query it visits
cells in the order of the sum of both halves' distances (multi-sequence traversal), as many as reach the target recall
for pairs right at the threshold, however many that takes. The vectors met are verified by cosine in double precision.

Vectors of different lengths never link. Each length with more than ``SIDE`` vectors has codebooks of its own; the
vectors of all other lengths are few for each, and of one label and length they lie in one cell.

Equal vectors of a label are one node with a weight, so copies cost nothing; a node with a hot cell is met in blocks.
Counts and a spanning forest leave each task, never all pairs. Vectors that were floats travel as floats.

Defined cases: rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components,
link with nothing; repeated rows count as other rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.grouped import over_groups
from millrace.llm.scratch import discard, least_hashed, map_batches, save

#: Distinct vectors from which codebooks and the number of visited cells are found; more for codebooks of over 625 words.
SAMPLE, FOR_A_WORD = 20_000, 32
#: Mean number of vectors in a cell that the codebooks' size aims at, and the most words of a codebook (of 16 million cells).
CELL, MOST_WORDS = 64, 4096
#: Vectors of either side that meet in one task.
SIDE = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[lo : lo + 4096] @ c.T, 1) for lo in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n, np.bincount(own, x[:, j], k) / np.maximum(n, 1), c[:, j])
    return c


def traverse(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each row's multi-sequence traversal.

    Of the sorted distances, the pair of ranks (i, j) comes after all pairs below it, so it is among the first
    ``visits`` only if (i + 1) * (j + 1) is at most that; these pairs alone are summed and sorted.
    """
    half = books[0].shape[1]
    d = [(b * b).sum(1) - 2 * h @ b.T for b, h in zip(books, (x[:, :half], x[:, half:]))]
    rank = [np.argsort(v, 1, kind="stable")[:, :visits] for v in d]
    near = [np.take_along_axis(v, r, 1) for v, r in zip(d, rank)]
    width = np.minimum(visits // (np.arange(near[0].shape[1]) + 1), near[1].shape[1])
    first = np.repeat(np.arange(len(width)), width)
    second = np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width)
    best = np.argsort(near[0][:, first] + near[1][:, second], 1, kind="stable")[:, :visits]
    return (np.take_along_axis(rank[0], first[best], 1) * len(books[1]) + np.take_along_axis(rank[1], second[best], 1)).astype(np.int32)


def visits_needed(a: np.ndarray, b: np.ndarray, books: tuple[np.ndarray, np.ndarray], recall: float) -> tuple[int, float]:
    """How many cells must be visited for the share ``recall`` of the pairs (a, b) to meet from either side, and the share that does.

    The number that is tried grows fourfold until it is enough; all cells are enough for all pairs.
    """
    every = len(books[0]) * len(books[1])
    most = min(every, 64)
    while True:
        met = np.empty(len(a), int)
        part = max(1, (1 << 21) // (most * 12))
        for lo in range(0, len(a), part):
            va, vb = traverse(a[lo : lo + part], books, most), traverse(b[lo : lo + part], books, most)
            met[lo : lo + part] = most + 1
            for v, own in ((va, vb[:, :1]), (vb, va[:, :1])):
                hit = v == own
                met[lo : lo + part] = np.minimum(met[lo : lo + part], np.where(hit.any(1), hit.argmax(1) + 1, most + 1))
        n = int(np.quantile(met, recall, method="higher"))
        if n <= most:
            return n, float((met <= n).mean())
        most = min(every, 4 * most)


def fit(x: np.ndarray, words: int, cosine: float, recall: float, seed: int = 11) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks from unit vectors, and the visits at which ``recall`` of pairs at exactly ``cosine`` meet (from either side)."""
    rng = np.random.default_rng(seed)
    half = x.shape[1] // 2
    k = max(1, min(words, len(x)))
    books = (_kmeans(x[:, :half], k, 12, rng), _kmeans(x[:, half:], k, 12, rng))
    a = x[rng.choice(len(x), min(len(x), 1000), replace=False)]
    turn = rng.standard_normal(a.shape)
    turn -= (turn * a).sum(1, keepdims=True) * a
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    return books, visits_needed(a, cosine * a + math.sqrt(1 - cosine * cosine) * turn, books, recall)[0]


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, visits = shared.value
        for batch in batches:
            cells = traverse(_unit(batch.column("vec")), books, visits)
            at = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
            cols = [batch.column(c) for c in ("label_key", "node", "weight", "vec")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cells[:, 0].copy()), pa.ListArray.from_arrays(at, cells.ravel())], ["label_key", "node", "weight", "vec", "own", "visits"])

    return run


def _meet(cosine: float):
    def fn(t: pa.Table) -> pa.Table | None:
        side = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        asks, held = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(asks) or not len(held):
            return None
        node, weight, own = (t.column(c).to_numpy() for c in ("node", "weight", "own"))
        x = _unit(t.column("vec").combine_chunks())
        seen = t.column("visits").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        names, of = np.unique(node, return_inverse=True)
        root, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        for lo in range(0, len(asks), 256):
            rows = asks[lo : lo + 256]
            near = x[rows] @ x[held].T >= cosine
            near &= node[rows][:, None] != node[held][None, :]
            p, m = np.nonzero(near)
            p, m = rows[p], held[m]
            np.add.at(links, of[p], weight[m])
            one_way = ~(seen[m] == own[p][:, None]).any(1)  # the other doesn't visit this one's cell, so counts it here
            np.add.at(links, of[m[one_way]], weight[p[one_way]])
            for i in np.unique(p):
                r = np.unique(root[np.concatenate((of[m[p == i]], [of[i]]))])
                if len(r) > 1:
                    root[np.isin(root, r[1:])] = r[0]
        some = links > 0
        return pa.table({"a": names[some], "b": names[root[some]], "links": links[some]}) if some.any() else None

    return fn


def near_vectors(vectors: DataFrame, *, cosine: float = 0.93, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Returns (vec_id, n_links long, component_id, kept boolean) for each row, linking vectors of equal labels."""
    spark = vectors.sparkSession
    v, vec = F.col(vec_col), F.col("vec")
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    # a label's vectors of each length are a label of their own
    label = F.xxhash64(F.col(label_col), F.size(v))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label_key"), F.col(label_col).isNotNull().alias("labelled"), v.cast(kind).alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(F.col("labelled") & vec.isNotNull() & finite, F.lit(False)), F.xxhash64("label_key", vec)))
    nodes = save(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("label_key").alias("label_key"), F.first("vec").alias("vec"), F.count("*").alias("weight")), "nodes")
    sizes = nodes.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.approx_count_distinct("label_key").alias("labels"))
    large = sizes.where(F.col("n") > SIDE).orderBy("width").collect()  # each has over SIDE vectors, so there are few
    schema = f"label_key long, node long, weight long, vec {kind}, own int, visits array<int>"
    others = nodes.where(~F.size("vec").isin([r["width"] for r in large])) if large else nodes
    coded = others.select("label_key", "node", "weight", "vec", F.lit(0).alias("own"), F.array(F.lit(0)).alias("visits"))
    for size in large:
        words = min(MOST_WORDS, max(4, round(math.sqrt(size["n"] / max(1, size["labels"]) / CELL))))
        of_size = nodes.where(F.size("vec") == size["width"])
        sample = least_hashed(of_size.select("vec", F.xxhash64("node").alias("o")), "o", max(SAMPLE, FOR_A_WORD * words), size["n"]).select("vec").toArrow().column("vec").combine_chunks()
        shared = spark.sparkContext.broadcast(fit(_unit(sample), words, cosine, recall))
        coded = coded.unionByName(map_batches(of_size, _code(shared), schema))
    coded = save(coded, "coded")
    asking = coded.withColumn("cell", F.explode("visits"))
    spot = ["label_key", "cell"]
    held = coded.groupBy("label_key", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("held_blocks"))
    asked = asking.groupBy(*spot).agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("ask_blocks"))
    # cells with too many vectors for one task are cut into blocks. These cells are a table of their own, of known size, so
    # that vectors are shuffled once where it is small enough to broadcast, and joined with it where it isn't
    large_cells = save(held.join(asked, spot).where((F.col("held_blocks") > 1) | (F.col("ask_blocks") > 1)), "cells")
    part = lambda n: F.pmod(F.xxhash64("node"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    cols = ["label_key", "cell", "node", "weight", "vec", "own", "visits"]
    a = asking.join(large_cells, spot, "left").select(*cols, part("ask_blocks").alias("i"), every("held_blocks").alias("j"), F.lit(True).alias("asks"))
    b = coded.withColumn("cell", F.col("own")).join(large_cells, spot, "left").select(*cols, every("ask_blocks").alias("i"), part("held_blocks").alias("j"), F.lit(False).alias("asks"))
    met = save(over_groups(a.unionByName(b), ["label_key", "cell", "i", "j"], _meet(cosine), "a long, b long, links long"), "met")
    settled = components(met.select("a", "b")).withColumnRenamed("node", "a")
    of_node = nodes.select(F.col("node").alias("a"), "weight").join(met.groupBy("a").agg(F.sum("links").alias("links")), "a", "left").join(settled, "a", "left")
    of_node = save(of_node.select(F.col("a").alias("node"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "a").alias("root")), "of_node")
    discard(nodes, coded, large_cells, met)

    full = save(rows.select("vec_id", "node").join(of_node, "node", "left"), "full")
    discard(of_node)
    least = full.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("least"))
    full = full.join(least, "root", "left")
    component = F.coalesce("least", "vec_id")
    return full.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
