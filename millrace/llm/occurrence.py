"""N-gram Jaccard self-join of texts by T-occurrence search.

Two texts link when the Jaccard similarity of their shingle sets reaches a threshold. Three passes over the texts:

1. Each text's set is hashed (equal sets share a key) and its prefix, the shingles of which any partner must share
   one, is counted with some shingles more, and the whole of one set in ``SAMPLED``: lines that many texts have lie beyond
   the first prefixes too. Frequent shingles are marked in a bitmap of fixed size. Marks only decide on an order.
2. Prefixes are taken again with marked shingles last. For each pair in a short list its common prefix shingles are
   counted; fewer than the bound below rule it out. The sets of a long list (mostly near copies of one another, as
   marked shingles come last) are chained in order of size. The components of what is left enclose all true links.
3. The sets of each enclosure meet in one task. A large enclosure is cut into bands of sizes, so wide that partners lie
   in one band or in two adjacent ones, and bands into blocks; each pair of blocks that may hold partners is a task.
   There an inverted index is searched for every set by DivideSkip: short lists are merged, long ones are probed by
   binary search, and sets that reach the needed overlap are joined.

Defined cases: null or blank texts have no shingles and link with nothing; repeated rows and equal sets link with one
another; rows with a null id link with nothing and have no component; extra columns are ignored; an empty table gives
no rows. No list, group or candidate is dropped for its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bitmaps import BITMAP_BITS, bitmap_of, marked, positions
from millrace.llm.components import components
from millrace.llm.grouped import over_groups
from millrace.llm.scratch import discard, map_batches, release, resting_on, save, unused
from millrace.llm.wordhash import shingle_sets, text_slices

#: A shingle in more prefixes than this is marked as frequent; marked ones are ordered last.
FREQUENT = 16
#: One set in so many is counted as a whole; a shingle in more than ``SAMPLE_FREQUENT`` of these is marked as well.
SAMPLED = 32
SAMPLE_FREQUENT = 2
#: Shingles of the sets that meet in one task.
BLOCK_ELEMENTS = 1_000_000
#: Lists of up to so many sets are counted pair by pair; the sets of longer ones are chained.
PAIRED = 24
#: Rows of lists that are handled at once.
LIST_ROWS = 200_000


def need(a, b, num: int, den: int):
    """The least overlap of sets of ``a`` and ``b`` elements whose Jaccard similarity is at least num/den."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -((-num * n) // den) + 1


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a sorted set."""
    i = np.arange(1, len(s) + 1, dtype=np.uint64)
    h = (s ^ (i * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    x = int((h * np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64)) ^ len(s)
    x = (x ^ (x >> 32)) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF
    return int(np.uint64(x ^ (x >> 29)).astype(np.int64))


def _id_hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _low_bits(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.uint32).view(np.int32))


def _profile(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, k)
                keys = [set_key(s) if len(s) else None for s in sets]
                # 32 bits will do: a shingle that shares them with another is at most marked for nothing
                heads = [s[: (p := prefix_length(len(s), num, den)) + p // 4 + 2] if len(s) else s for s in sets]
                whole = [s if key is not None and key % SAMPLED == 0 else s[:0] for s, key in zip(sets, keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.int64()),
                        _low_bits(heads),
                        _low_bits(whole),
                    ],
                    ["doc_id", "n_shingles", "set_key", "head", "whole"],
                )

    return run


def _postings(k: int, num: int, den: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(1)):
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for s in shingle_sets(texts, k):
                    if not len(s):
                        continue
                    p = prefix_length(len(s), num, den)
                    late = marked(bitmap, s)
                    order = np.concatenate((np.flatnonzero(late == 0)[:p], np.flatnonzero(late)[:p]))[:p]
                    rank = int(s[order[-1]] >> np.uint64(34)) | int(late[order[-1]]) << 30  # of the last in the common order, its first bits
                    for c, v in zip(cols, (s[order].view(np.int64), np.full(p, set_key(s), np.int64), np.full(p, len(s), np.int32), np.full(p, rank, np.int32))):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "set_key", "n", "last"])

    return run


def _candidates(num: int, den: int):
    """From lists in order of (h, n, set_key): rows (a, b, need) for sets that may be partners.

    Of two prefixes, let x's be the one that ends first. What x and y share is either in both prefixes or among the
    other shingles of x; so a linked pair has at least ``need`` = T - (size of x - prefix of x) common prefix shingles,
    and a row is given for each of them. Chained sets get rows with a need of 0. A pair with a common long list is
    held together by its chain, all other pairs' common shingles are all in short lists, so no link is lost.
    """

    def lists(h, key, n, last, long_h):
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((starts, [len(h)])))
        long = (size > PAIRED) | np.isin(h[starts], np.array(long_h, np.int64))
        n = n.astype(np.int64)
        out = []
        if long.any():
            x = np.flatnonzero(np.repeat(long, size)[:-1] & (h[1:] == h[:-1]))
            x = x[n[x] * den >= n[x + 1] * num]
            out.append((key[x], key[x + 1], np.zeros(len(x), np.int64)))
        for s in range(2, PAIRED + 1):
            at = starts[(size == s) & ~long]
            if len(at):
                i, j = np.triu_indices(s, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                near = n[x] * den >= n[y] * num
                x, y = x[near], y[near]
                beyond = -((-num * n) // den) - 1  # shingles outside the prefix
                # where the ends' first bits are equal, either may be first: the larger rest gives the smaller need
                rest = np.where(last[x] < last[y], beyond[x], np.where(last[x] > last[y], beyond[y], np.maximum(beyond[x], beyond[y])))
                out.append((key[x], key[y], np.maximum(1, need(n[x], n[y], num, den) - rest)))
        if out:
            a, b, c = (np.concatenate(v) for v in zip(*out))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], ["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        long_h: list[int] = []  # the shingle whose list goes on and is known to be long

        def flush(final: bool):
            nonlocal held, long_h
            h, key, n, last = (np.concatenate(c) for c in zip(*held))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))  # equal sets count once
            h, key, n, last = h[new], key[new], n[new], last[new]
            cut = len(h) if final else int(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[-1])
            if len(h) - cut > PAIRED or not final and long_h == [int(h[-1])]:  # of a long list only the last row is needed
                yield from lists(h, key, n, last, [*long_h, int(h[-1])])  # the list carried on from the chunk before may end in this one
                long_h, cut = [int(h[-1])], len(h) - 1
            elif cut:
                yield from lists(h[:cut], key[:cut], n[:cut], last[:cut], long_h)
                long_h = []
            held = [(h[cut:], key[cut:], n[cut:], last[cut:])]

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("h", "set_key", "n", "last")))
            size += batch.num_rows
            if size >= LIST_ROWS:
                yield from flush(False)
                size = 0
        if held:
            yield from flush(True)

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Joins all sets (sorted, distinct, non-empty) of Jaccard similarity at least num/den; returns the root of each.

    For a query set and the least overlap T with any partner, the inverted lists of its shingles are split: up to T - 1
    of the longest are set apart, the others are merged with counts, and those sets that the merge leaves within reach
    of T are looked up in the long lists by binary search. Sets already joined with the query aren't looked up again.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    values, ends = flat[heads], np.concatenate((heads[1:], [len(flat)]))
    rank = np.argsort(n, kind="stable")
    roots = np.arange(m)
    for q in rank.tolist():
        at = np.searchsorted(values, sets[q])
        length = ends[at] - heads[at]
        at = at[length > 1]
        low = -(-n[q] * num // den)  # the smallest partner
        t = need(n[q], low, num, den)
        if len(at) < t:
            continue
        by = np.argsort(heads[at] - ends[at], kind="stable")  # longest first
        longest = min(int(t) - 1, int(np.count_nonzero(ends[at] - heads[at] > 8)))
        long, short = at[by[:longest]], at[by[longest:]]
        merged = np.sort(np.concatenate([owner[heads[i] : ends[i]] for i in short.tolist()]))
        edge = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, count = merged[edge], np.diff(np.concatenate((edge, [len(merged)])))
        t_each = need(n[q], n[found], num, den)
        keep = (found != q) & (n[found] * den >= n[q] * num) & (n[found] * num <= n[q] * den) & (count + longest >= t_each)
        keep &= roots[found] != roots[q]
        found, count, t_each = found[keep], count[keep], t_each[keep]
        left = longest
        for i in long.tolist():
            if not len(found):
                break
            held = owner[heads[i] : ends[i]]
            spot = np.searchsorted(held, found)
            count = count + ((spot < len(held)) & (held[np.minimum(spot, len(held) - 1)] == found))
            left -= 1
            alive = count + left >= t_each
            if not alive.all():
                found, count, t_each = found[alive], count[alive], t_each[alive]
        for x in found[count >= t_each].tolist():
            lo, hi = sorted((int(roots[q]), int(roots[x])))
            if lo < hi:
                roots[roots == hi] = lo
    return roots


def _search(num: int, den: int):
    def fn(t: pa.Table) -> pa.Table | None:
        keys, first = np.unique(t.column("set_key").to_numpy(), return_index=True)
        if len(keys) < 2:
            return None
        blobs = t.column("shingles").take(pa.array(first)).to_pylist()
        roots = divide_skip([np.frombuffer(x, np.uint64) for x in blobs], num, den)
        linked = roots != np.arange(len(keys))
        return pa.table({"a": keys[linked], "b": keys[roots[linked]]}) if linked.any() else None

    return fn


def _ship(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            # with nulls left in, the column would become doubles, and large ids be rounded
            wanted = np.flatnonzero(marked(bitmap, _id_hash(ids.fill_null(0).to_numpy())) & known)
            picked = batch.take(pa.array(wanted))
            for lo, hi, texts in text_slices(picked.column(1)):
                rows = [(i, set_key(s), s.tobytes()) for i, s in zip(range(lo, hi), shingle_sets(texts, k)) if len(s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([picked.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "set_key", "shingles"])

    return run


#: What names a task of the search: blocks i and j of one band, or i of a band and j of the next one (``up``).
TASK = ["root", "band", "up", "i", "j"]


def _tasks(held: DataFrame, num: int, den: int) -> DataFrame:
    """held: (set_key, rep, n, root). Returns (set_key, doc_id, *TASK), one row for each task that a set goes to.

    Sets of one root that may be partners meet in some task: sizes of partners are within a factor of den/num, so their
    bands are the same or adjacent. An enclosure of at most BLOCK_ELEMENTS is one task.
    """
    width = math.log(den / num) * (1 + 1e-9) if num < den else 1e-9  # wider than the factor by more than logarithms are off
    total = held.groupBy("root").agg(F.sum("n").alias("total"))
    band = F.when(F.col("total") <= BLOCK_ELEMENTS, 0).otherwise(F.floor(F.log("n") / width)).cast("long")
    sized = held.join(total, "root").select("set_key", F.col("rep").alias("doc_id"), "n", "root", band.alias("band"))
    cells = sized.groupBy("root", "band").agg(F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    parts = sized.join(cells, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")  # a set goes to the task of each pair of blocks that holds its own
    known = ["set_key", "doc_id", "root", "band"]
    own = parts.select(*known, "block", every).select(*known, F.lit(0).alias("up"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    after = cells.select("root", (F.col("band") - 1).alias("band"), "blocks")
    before = cells.select("root", (F.col("band") + 1).alias("band"), "blocks")
    up = parts.drop("blocks").join(after, ["root", "band"]).select(*known, "block", every).select(*known, F.lit(1).alias("up"), F.col("block").alias("i"), F.col("other").alias("j"))
    down = parts.drop("blocks").join(before, ["root", "band"]).select(*known, "block", every).select("set_key", "doc_id", "root", (F.col("band") - 1).alias("band"), F.lit(1).alias("up"), F.col("other").alias("i"), F.col("block").alias("j"))
    return own.unionByName(up).unionByName(down)


def _classes(texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """texts: (doc_id long, text string). Returns two tables that outlive the call.

    The first has (doc_id, n_shingles, set_key, head) of each row, the second (set_key, least) of each set of a row with an id:
    the least id in the set's component.
    """
    spark = texts.sparkSession
    profile = save(map_batches(texts, _profile(words, num, den), "doc_id long, n_shingles long, set_key long, head array<int>, whole array<int>"), "profile")

    often = [
        profile.select(F.explode(c).alias("h")).groupBy("h").count().where(F.col("count") > least).select((F.col("h").bitwiseAND(BITMAP_BITS - 1)).alias("position"))
        for c, least in (("head", FREQUENT), ("whole", SAMPLE_FREQUENT))
    ]
    frequent = spark.sparkContext.broadcast(bitmap_of(often[0].unionByName(often[1])))
    release(spark)
    postings = map_batches(texts, _postings(words, num, den, frequent), "h long, set_key long, n int, last int")
    listed = postings.repartition("h").sortWithinPartitions("h", "n", "set_key")
    # lists are cut into chunks of a fixed number of rows, not into small batches
    pairs = listed.mapInArrow(_candidates(num, den), "a long, b long, need long").groupBy("a", "b").agg(F.count("*").alias("common"), F.min("need").alias("need"))
    enclosed = components(pairs.where(F.col("common") >= F.col("need")))
    release(spark)

    some = profile.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    of_key = save(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "sets")
    held = save(of_key.select("set_key", "rep", "n").join(enclosed.withColumnRenamed("node", "set_key"), "set_key"), "enclosed")
    parts = _tasks(held, num, den)

    wanted = spark.sparkContext.broadcast(bitmap_of(map_batches(held.select(F.col("rep").alias("doc_id")).distinct(), _id_positions, "position int")))
    shipped = map_batches(texts, _ship(words, wanted), "doc_id long, set_key long, shingles binary")
    met = shipped.join(parts, ["doc_id", "set_key"]).select(*TASK, "set_key", "shingles")
    links = over_groups(met, TASK, _search(num, den), "a long, b long")
    settled = components(links)
    release(spark)

    # the least id of each distinct set is found first; saved, so that the last join has the sets' rows on one side only
    # and a set of very many copies can be split there
    linked = save(of_key.join(settled.withColumnRenamed("node", "set_key"), "set_key").select("set_key", "rep", "root"), "linked")
    least = save(linked.groupBy("root").agg(F.min("rep").alias("least")), "least")
    of_linked = linked.join(least, "root").select("set_key", "least")
    led = save(of_key.join(of_linked, "set_key", "left").select("set_key", F.coalesce("least", "rep").alias("least")), "led")
    discard(of_key, held, linked, least)
    return profile, led


def jaccard_components(docs: DataFrame, *, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose sets of ``words``-word shingles have Jaccard similarity at least num/den.

    Returns (doc_id long, n_shingles long, component_id long) for each row; component_id is the least id reachable.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile, led = _classes(texts, words, num, den)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = profile.select("doc_id", "n_shingles", "set_key").join(led, "set_key", "left").select("doc_id", "n_shingles", found.alias("component_id"))
    return resting_on(out, profile, led)


def _id_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(positions(_id_hash(batch.column(0).to_numpy())))], ["position"])


def keep_one(docs: DataFrame, *, words: int = 5, num: int = 8, den: int = 10, text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked texts, with all columns.

    Rows are told apart by a number of their own, so neither repeated nor null ids matter: equal texts are one group
    whatever their ids, and the first row of a group stays. Rows without words link with nothing and all stay.
    """
    row = unused("row", docs.columns)
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile, led = _classes(texts, words, num, den)
    # few rows go; a bitmap tells those that may, and only their texts are shuffled to be compared with the rows that do go
    gone = save(profile.where(F.col("set_key").isNotNull()).join(led, "set_key").where(F.col("doc_id") != F.col("least")).select("doc_id"), "gone")
    discard(profile, led)
    release(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(map_batches(gone, _id_positions, "position int")))

    @F.pandas_udf("boolean")
    def may_go(rows: pd.Series) -> pd.Series:
        return pd.Series(marked(np.frombuffer(bits.value, np.uint8), _id_hash(rows.to_numpy())).astype(bool))

    flag = unused("may_go", numbered.columns)
    flagged = numbered.withColumn(flag, may_go(row))
    stay = flagged.where(~F.col(flag)).select(*numbered.columns)
    seen = flagged.where(F.col(flag)).select(*numbered.columns).join(gone.withColumnRenamed("doc_id", row), row, "left_anti")
    return resting_on(stay.unionByName(seen).select(*docs.columns), numbered, gone)
