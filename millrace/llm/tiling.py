"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. Items and texts that share a run of ``least`` words (a seed, found
by its Karp-Rabin hash) are tiled: of all matches, the longest that crosses no marked word is marked, again and again,
down to ``least`` words. The marked share of an item is its coverage, so passages count in whatever order their parts
stand. The longest unmarked match is found by running Karp-Rabin hashes of one length at a time, so matches are never
listed: time and memory are linear in both texts for each length that is tried, whatever repeats in them.

An item with fewer words than ``least`` matches a text that consists of exactly its words, and no other.

The benchmark is met in slices of about ``SLICE_WORDS`` words: the driver holds one slice at a time, and each is
broadcast (its size is thereby bounded; an item that is larger is a slice of its own). Where there is more than one, a
first pass over the texts keeps those that share a seed with any item (by a bitmap of fixed size), and the slices see
only these.

Defined cases: null and empty texts and items match nothing; repeated rows match each, and each is dropped or kept for
its own text, whatever its id; repeated items (equal id) count as items of their own; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bitmaps import bitmap_of, marked, positions
from millrace.llm.scratch import discard, map_batches, save
from millrace.llm.wordhash import ALNUM, hash_runs, hash_words, mix

LEAST = 5
COVERAGE = 0.5
SLICE_WORDS = 2_000_000
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
MATCH = "doc_id long, item_id long, item_words long, tiled_words long, n_tiles long, text_words long"


def _hashed(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Word hashes of each text, with its position."""
    i = 0
    while i < len(texts):
        first, blobs, size = i, [], 0
        while i < len(texts) and (not blobs or size < 1 << 20):
            blobs.append((texts[i] or "").lower().encode("utf-8", "replace"))
            size += len(blobs[-1])
            i += 1
        h, at = hash_words(blobs, ALNUM)
        for k in range(len(blobs)):
            yield first + k, h[at[k] : at[k + 1]]


def _seeds(h: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of ``least`` words; of a shorter sequence, one hash of the whole."""
    if len(h) >= least or not len(h):
        return hash_runs(h, least)
    return hash_runs(h, len(h)) ^ np.uint64(len(h))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Words:
    """A word sequence of which words get marked; hashes of its unmarked runs of any length, from prefix sums."""

    def __init__(self, h: np.ndarray, free: np.ndarray | None = None):
        self.h = h
        self.free = np.ones(len(h), bool) if free is None else free
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)))
        self.down = _powers(_INVERSE, len(h))
        self.measure()

    def measure(self) -> None:
        """How many unmarked words follow from each position on."""
        n = len(self.h)
        stop = np.where(self.free, n, np.arange(n))
        self.room = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.room >= length)
        return at, mix((self.sums[at + length] - self.sums[at]) * self.down[at])


def _longest(a: _Words, b: _Words, least: int, most: int) -> int:
    """The greatest length up to ``most`` of a common unmarked run, or 0 below ``least``: part of a run is a run as well."""
    low, high = 0, min(most, int(a.room.max(initial=0)), int(b.room.max(initial=0)))
    while low < high and high >= least:
        middle = max(least, (low + high + 1) // 2)
        if np.isin(a.runs(middle)[1], b.runs(middle)[1]).any():
            low = middle
        else:
            high = middle - 1
    return low


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, text position, length) between two word sequences, each at least ``least`` long.

    Longest first; among equals the first in the item, then in the text.
    """
    seed_a, seed_b = hash_runs(item, least), hash_runs(text, least)
    hit = np.isin(seed_b, seed_a)
    if not hit.any():
        return []
    # only words of the text that a seed covers matter: they are drawn together, with a marked word between stretches
    edge = np.zeros(len(text) + 1, np.int64)
    edge[np.flatnonzero(hit)] += 1
    np.subtract.at(edge, np.flatnonzero(hit) + least, 1)
    where = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gap = np.flatnonzero(np.diff(where) > 1) + 1
    where = np.insert(where, gap, -1)
    a, b = _Words(item), _Words(text[where], where >= 0)
    out, length = [], len(item)
    while True:
        length = _longest(a, b, least, length)
        if not length:
            return out
        (at, key), (to, other) = a.runs(length), b.runs(length)
        both = np.isin(key, other)
        order = np.argsort(other, kind="stable")
        other, to = other[order], to[order]
        next_of: dict[int, int] = {}
        clear = 0
        for i, k, spot in zip(at[both].tolist(), key[both].tolist(), np.searchsorted(other, key[both]).tolist()):
            if i < clear:
                continue
            spot = next_of.get(k, spot)
            while spot < len(to) and other[spot] == k:
                j = int(to[spot])
                spot += 1
                # marked runs of this round are as long, so they cover one end of what they cover
                if b.free[j] and b.free[j + length - 1] and np.array_equal(item[i : i + length], b.h[j : j + length]):
                    a.free[i : i + length] = False
                    b.free[j : j + length] = False
                    out.append((i, int(where[j]), length))
                    clear = i + length
                    break
            next_of[k] = spot
        a.measure()
        b.measure()
        length -= 1


class Slice:
    """Items that meet all texts at once: a table from seed hashes to items."""

    def __init__(self, ids: list[int | None], items: list[np.ndarray], least: int):
        self.ids, self.items, self.least = ids, items, least
        seeds = [np.unique(_seeds(x, least)) for x in items]
        key = np.concatenate([*seeds, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s in seeds])
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]

    def found(self, h: np.ndarray, coverage: float = 0.0) -> Iterator[tuple[int, int, int]]:
        """(item, tiled words, tiles) of each item that shares a seed with a text.

        Items of which common seeds cover less than ``coverage`` are left out unseen: tiles lie within common seeds.
        """
        least, key = self.least, self.key
        here = np.unique(_seeds(h, least))
        if not len(here) or not len(key):
            return
        lo, hi = np.searchsorted(key, here), np.searchsorted(key, here, side="right")
        met = [self.item[a:b] for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist())]
        here = here[hi > lo]
        for i in np.unique(np.concatenate(met)).tolist() if met else ():
            item = self.items[i]
            if len(item) < least:
                if np.array_equal(item, h):
                    yield i, len(item), 1
                continue
            at = np.flatnonzero(np.isin(hash_runs(item, least), here))
            covered = int(np.minimum(np.diff(at), least).sum()) + least
            if covered >= coverage * len(item):
                t = tiles(item, h, least)
                if t:
                    yield i, sum(x[2] for x in t), len(t)


def _pairs(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            doc_ids, rows = batch.column(0), []
            for d, h in _hashed(batch.column(1).to_pylist()):
                rows += [(d, part.ids[i], len(part.items[i]), n, k, len(h)) for i, n, k in part.found(h, coverage) if n >= coverage * len(part.items[i])]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "item_words", "tiled_words", "n_tiles", "text_words"])

    return run


def _clean(shared, column: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            bad = [any(n >= coverage * len(part.items[i]) for i, n, _ in part.found(h, coverage)) for _, h in _hashed(batch.column(column).to_pylist())]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return run


def _touched(shared, column: int, least: int, wanted: bool):
    """Rows whose text has a seed in the bitmap (or, not wanted, has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            hit = [bool(marked(bits, _seeds(h, least)).any()) == wanted for _, h in _hashed(batch.column(column).to_pylist())]
            yield batch.filter(pa.array(hit, pa.bool_()))

    return run


class _Benchmark:
    """The items in slices, and a bitmap of all their seeds."""

    def __init__(self, benchmark: DataFrame, item_id: str, item_text: str, least: int):
        self.least = least
        self.rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0)
        total = self.rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        self.slices = max(1, -(-total // (2 * SLICE_WORDS)))

    def __iter__(self):
        """A broadcast slice at a time; the one before is gone by then."""
        context = self.rows.sparkSession.sparkContext
        for s in range(self.slices):
            part = self.rows if self.slices == 1 else self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.slices)) == s)
            got = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
            yield context.broadcast(Slice([r[0] for r in got], [h for _, h in _hashed([r[1] for r in got])], self.least))

    def bitmap(self):
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, h in _hashed(batch.column(0).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(positions(_seeds(h, least)))], ["position"])

        return self.rows.sparkSession.sparkContext.broadcast(bitmap_of(map_batches(self.rows.select("text"), run, "position int")))


def matches(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, at_least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All (doc_id, item_id, item_words, tiled_words, n_tiles, text_words long) that share a seed and tile the share ``at_least`` of the item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _Benchmark(benchmark, item_id, item_text, least)
    if items.slices > 1:
        rows = save(map_batches(rows, _touched(items.bitmap(), 1, least, True), rows.schema), "touched")
    out = None
    for shared in items:
        found = map_batches(rows, _pairs(shared, at_least), MATCH)
        if items.slices > 1:  # done with the slice
            found = save(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if items.slices > 1:
        discard(rows)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, **how) -> DataFrame:
    """The matches that tile at least ``coverage`` of an item: (doc_id, item_id, ..., coverage double, contaminated boolean)."""
    share = F.col("tiled_words") / F.col("item_words")
    return matches(docs, benchmark, at_least=coverage, **how).withColumn("coverage", share).withColumn("contaminated", F.lit(True))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, least: int = LEAST, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose own text isn't contaminated."""
    column, schema = docs.columns.index(text_col), docs.schema
    items = _Benchmark(benchmark, item_id, item_text, least)
    if items.slices == 1:
        return map_batches(docs, _clean(next(iter(items)), column, coverage), schema)
    bits = items.bitmap()
    left = save(map_batches(docs, _touched(bits, column, least, True), schema), "touched")
    for shared in items:
        last, left = left, save(map_batches(left, _clean(shared, column, coverage), schema), "clean")
        discard(last)
        shared.destroy()
    return map_batches(docs, _touched(bits, column, least, False), schema).unionByName(left)
