"""Cost-balanced packing: sequences of bounded tokens and nearly equal attention cost.

A segment of n tokens costs ``linear * n + quadratic * n * n``. Documents are taken in descending order of tokens; each
goes to the sequence of lowest cost among those with enough room. There are just as many sequences as the tokens need,
so where no room is left for a whole document it is cut: the roomiest sequence takes what it holds and the rest is
placed by its own length.

Defined cases: a null text is empty and has its end token only; repeated rows are packed each; ids of rows may be null;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.grouped import over_groups
from millrace.llm.packing import encoded_blocks
from millrace.llm.wordids import ChunkTokenizer

#: Cost of a token and of a pair of tokens, relative to each other: both are equal at 2048 tokens.
LINEAR, QUADRATIC = 2048.0, 1.0


def balance(lengths: list[int], width: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold each item's tokens once, in the least number of sequences."""
    n = -(-sum(lengths) // width)
    left = [width] * n
    cost = [0.0] * n
    cheap = [(0.0, s) for s in range(n)]  # sequences that may have room for the piece at hand
    full: list[tuple[int, int]] = []  # the others, by room: pieces only get shorter, so one comes back when its room does
    pieces = [(-length, item, 0) for item, length in enumerate(lengths) if length]
    heapq.heapify(pieces)
    out = []

    def place(s: int, item: int, start: int, length: int) -> None:
        out.append((item, start, length, s, width - left[s]))
        left[s] -= length
        cost[s] += linear * length + quadratic * length * length

    while pieces:
        length, item, start = heapq.heappop(pieces)
        length = -length
        if length > width:
            heapq.heappush(pieces, (-width, item, start))
            heapq.heappush(pieces, (width - length, item, start + width))
            continue
        while full and -full[0][0] >= length:
            _, s = heapq.heappop(full)
            heapq.heappush(cheap, (cost[s], s))
        while cheap and left[cheap[0][1]] < length:
            _, s = heapq.heappop(cheap)
            if left[s]:
                heapq.heappush(full, (-left[s], s))
        if cheap:
            _, s = heapq.heappop(cheap)
            place(s, item, start, length)
            heapq.heappush(cheap, (cost[s], s))
        else:
            room, s = heapq.heappop(full)
            place(s, item, start, -room)
            heapq.heappush(pieces, (-(length + room), item, start - room))
    return out


def _pack(width: int, dtype: np.dtype):
    def fn(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("row").to_numpy(), kind="stable")))
        ids = [np.frombuffer(x, dtype) for x in t.column("ids").to_pylist()]
        base = t.column("block")[0].as_py() << 32
        pieces = balance([len(x) for x in ids], width)
        item, start, length, sequence, offset = (np.array(c, np.int64) for c in (zip(*pieces) if pieces else [[]] * 5))
        crc = [zlib.crc32(ids[i][a : a + n].astype("<u4").tobytes()) for i, a, n, *_ in pieces]
        tokens = np.array([len(x) for x in ids], np.int64)
        cols = [t.column("doc_id").take(pa.array(item)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[item]), pa.array(sequence | base), pa.array(offset)]
        return pa.table(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return fn


def pack(docs: DataFrame, tokenizer: str, *, width: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset long)."""
    dtype = ChunkTokenizer.at(tokenizer).dtype
    blocks = encoded_blocks(docs, tokenizer, end_id, id_col, text_col)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return over_groups(blocks, ["block"], _pack(width, dtype), schema)
