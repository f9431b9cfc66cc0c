"""Best-fit-decreasing packing of token ids into fixed-width sequences.

Documents are cut into whole sequences and a rest (losslessly); rests are taken in descending order, each into the open
sequence with the least room that still holds it. Sequences are found by room: a segment tree over room sizes holds
which sizes occur, and answers "the least size of at least n" in a logarithm of the width.

Written for each sequence: the ids (padded to the width), the cumulative lengths of its segments, and each token's
position within its segment.

Defined cases: a null text is empty and has its end token only (none at all without an end token); repeated rows are
packed each; ids of rows may be null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.grouped import over_groups
from millrace.llm.packing import encoded_blocks
from millrace.llm.wordids import ChunkTokenizer


class Rooms:
    """Open sequences by room; a segment tree of counts over room sizes 0..width."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        if len(self.open[room]) == 1:
            self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The (room, sequence) of least room of at least ``least``; the one put last among equals."""
        room = self._at_least(least)
        if room is None:
            return None
        sequence = self.open[room].pop()
        if not self.open[room]:
            self._add(room, -1)
        return room, sequence

    def _add(self, leaf: int, by: int) -> None:
        i = leaf + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def _at_least(self, least: int) -> int | None:
        if least >= len(self.open):
            return None
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: list[int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold each item's tokens once, in sequences 0, 1, ..."""
    out, rests, n = [], [], 0
    for item, length in enumerate(lengths):
        full = length // width
        for k in range(full):
            out.append((item, k * width, width, n, 0))
            n += 1
        if length % width:
            rests.append((length % width, item, full * width))
    rests.sort(key=lambda r: (-r[0], r[1]))
    rooms = Rooms(width)
    for length, item, start in rests:
        got = rooms.take(length)
        if got is None:
            got = width, n
            n += 1
        room, sequence = got
        out.append((item, start, length, sequence, width - room))
        rooms.put(room - length, sequence)
    return out


def _pack(width: int, dtype: np.dtype, pad_id: int):
    def fn(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("row").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids = [np.frombuffer(x, dtype) for x in t.column("ids").to_pylist()]
        doc = t.column("doc_id").to_pylist()
        base = t.column("block")[0].as_py() << 32
        pieces = sorted(best_fit([len(x) for x in ids], width), key=lambda p: (p[3], p[4]))
        rows = []
        i = 0
        while i < len(pieces):
            j = i
            while j < len(pieces) and pieces[j][3] == pieces[i][3]:
                j += 1
            grid = np.full(width, pad_id, dtype)
            where = np.zeros(width, "<u2" if width <= 1 << 16 else "<u4")
            cut = [0]
            for item, start, length, _, offset in pieces[i:j]:
                grid[offset : offset + length] = ids[item][start : start + length]
                where[offset : offset + length] = np.arange(length)
                cut.append(offset + length)
            rows.append((base | pieces[i][3], grid.tobytes(), where.tobytes(), cut, [doc[p[0]] for p in pieces[i:j]], [p[1] for p in pieces[i:j]]))
            i = j
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["sequence_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])

    return fn


def pack(docs: DataFrame, tokenizer: str, *, width: int = 4096, end_id: int | None = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sequence: (sequence_id long, input_ids binary, position_ids binary, cu_seqlens, doc_ids, starts arrays).

    input_ids and position_ids are rows of matrices, ``width`` little-endian unsigned integers of two bytes (four where
    the vocabulary or the width needs them). cu_seqlens begins with 0 and ends with the tokens in the sequence; segment k
    has tokens of doc_ids[k] from its token starts[k] on.
    """
    dtype = ChunkTokenizer.at(tokenizer).dtype
    blocks = encoded_blocks(docs, tokenizer, end_id, id_col, text_col)
    schema = "sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
    return over_groups(blocks, ["block"], _pack(width, dtype, pad_id), schema)


def write(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet files, a row for each sequence, in the order of their ids within each file."""
    packed.sortWithinPartitions("sequence_id").write.mode("overwrite").parquet(path)
