"""Balanced sharding of a corpus by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard. Differencing keeps partial partitions (shard sums in descending
order) and repeatedly merges the two of largest spread, one of them turned round, so that the largest sum of one meets
the smallest of the other. At scale, groups are dealt into blocks of bounded size by hash; each block is differenced in
a task of its own, and the blocks' partial partitions are merged the same way, ``FAN`` at a time, up to one.

Law ``bytes``: shard sizes are as near to equal as the largest group allows. Defined cases: a null text is empty and
has the size of its overhead only; equal rows share a shard and each get a slot; extra columns are ignored; an empty
table gives no rows; ids may be null.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import discard, save

#: Groups in a block, and partial partitions merged in one task or in the driver.
BLOCK_GROUPS = 20_000
FAN = 1024
OVERHEAD = 16
#: Groups with at least one HOT-th of all rows are joined by a broadcast.
HOT = 16_384


def difference(parts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Merges partial partitions (k sums each, descending); returns, for each, the final place of each of its sums.

    Final places are numbered by descending sum. Ties of spread are broken by position, ties of sums by place.
    """
    n = len(parts)
    if not n:
        return []
    sums = dict(enumerate(parts))
    heap = [(-int(p[0] - p[-1]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        place = np.empty(k, np.uint8 if k <= 256 else np.int32)
        place[order] = np.arange(k)
        both = both[order]
        i = n + len(joined)
        joined.append((a, b, place))
        sums[i] = both
        heapq.heappush(heap, (-int(both[0] - both[-1]), i))
    final: dict[int, np.ndarray] = {n + len(joined) - 1: np.arange(k)}
    for i in range(len(joined) - 1, -1, -1):
        a, b, place = joined[i]
        to = final.pop(n + i)[place]
        final[a], final[b] = to, to[::-1]
    return [final[i] for i in range(n)]


def _block(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g", "text_crc32"], ascending=[False, True, True], ignore_index=True)
        parts = np.zeros((len(pdf), k), np.int64)
        parts[:, 0] = pdf["bytes"].to_numpy()
        spots = np.array([p[0] for p in difference(list(parts), k)])
        return pdf.assign(place=spots.astype(np.int32))[["g", "text_crc32", "size", "block", "place", "bytes"]]

    return fn


def _merge(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """pdf: node, place, bytes -> node, place, to (the place in the merged partition), bytes."""
    nodes = np.unique(pdf["node"].to_numpy())
    grid = np.zeros((len(nodes), k), np.int64)
    grid[np.searchsorted(nodes, pdf["node"].to_numpy()), pdf["place"].to_numpy()] = pdf["bytes"].to_numpy()
    order = np.argsort(-grid, axis=1, kind="stable")
    to = np.empty_like(grid)
    for i, f in enumerate(difference(list(np.take_along_axis(grid, order, 1)), k)):
        to[i, order[i]] = f
    return pd.DataFrame({"node": np.repeat(nodes, k), "place": np.tile(np.arange(k, dtype=np.int32), len(nodes)), "to": to.ravel().astype(np.int32), "bytes": grid.ravel()})


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, size, text_crc32 long, law string, shard int, slot long, grown_shard int) for each row.

    size: UTF-8 bytes of the text plus 16. slot: gapless from 0 in each shard. grown_shard: null under this law.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    rows = save(rows, "sizes")
    key = ["g", "text_crc32", "size"]
    groups = save(rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    seen = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    blocks = max(1, -(-seen["groups"] // BLOCK_GROUPS))
    dealt = groups.drop("n").withColumn("block", F.pmod(F.hash("g", "text_crc32"), F.lit(blocks)).cast("long"))
    placed = save(dealt.groupBy("block").applyInPandas(_block(shards), "g long, text_crc32 long, size long, block long, place int, bytes long"), "placed")

    nodes = placed.groupBy(F.col("block").alias("node"), "place").agg(F.sum("bytes").alias("bytes"))
    home = None  # (block, place) -> (node, at) so far
    while blocks > FAN:
        schema = "node long, place int, to int, bytes long"
        merged = save(nodes.withColumn("up", F.floor(F.col("node") / FAN)).groupBy("up").applyInPandas(lambda pdf: _merge(pdf, shards), schema), "merged")
        step = merged.select("node", F.col("place").alias("at"), F.floor(F.col("node") / FAN).alias("up"), F.col("to").alias("up_at"))
        if home is None:
            home = step.select(F.col("node").alias("block"), F.col("at").alias("place"), F.col("up").alias("node"), F.col("up_at").alias("at"))
        else:
            home = home.join(step, ["node", "at"]).select("block", "place", F.col("up").alias("node"), F.col("up_at").alias("at"))
        home = save(home, "home")
        nodes = merged.groupBy(F.floor(F.col("node") / FAN).alias("node"), F.col("to").alias("place")).agg(F.sum("bytes").alias("bytes"))
        blocks = -(-blocks // FAN)
    top = _merge(nodes.toPandas(), shards) if seen["groups"] else pd.DataFrame({"node": [], "place": [], "to": []})
    last = spark.createDataFrame(top[["node", "place", "to"]].astype("int64"), "node long, place long, to long").select("node", F.col("place").cast("int").alias("at"), F.col("to").cast("int").alias("shard"))
    if home is None:
        home = last.select(F.col("node").alias("block"), F.col("at").alias("place"), "shard")
    else:
        home = home.join(last, ["node", "at"]).select("block", "place", "shard")
    where = save(placed.join(home, ["block", "place"]).select(*key, "shard"), "where")

    # a group with a large share of all rows is looked up in a broadcast (there are at most HOT of these), so that no task
    # of the join gets all of its rows; all others are joined
    n_rows = seen["rows"] or 0
    hot = F.broadcast(groups.where(F.col("n") * HOT >= n_rows).select(*key).join(where, key).withColumnRenamed("shard", "hot"))
    looked = rows.join(hot, key, "left")
    rest = looked.where(F.col("hot").isNull()).drop("hot").join(where, key)
    homed = looked.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "shard").unionByName(rest)

    # slots: rows of a shard are dealt into buckets by a number of their own, whatever their ids and texts; a row's slot is
    # its place in its bucket after all earlier buckets
    buckets = max(16, -(-n_rows // (shards * 20_000)))
    found = save(homed.select("row", "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")), "found")
    discard(rows, groups, placed, where)
    counts = found.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    slotted = found.withColumn("nth", F.row_number().over(within)).join(offsets, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - 1 + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
