"""What both packing operators share: texts become ids, dealt by hash into blocks of bounded size.

A block is packed in one task; blocks hold about ``BLOCK_BYTES`` of text whatever the corpus size, so only the number
of blocks grows. Each loses less than one sequence to its last, unfilled one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import map_batches, save
from millrace.llm.wordids import ChunkTokenizer

BLOCK_BYTES = 6 << 20


def encoded_blocks(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(block long, doc_id long, row long, ids binary): every row of ``docs``, tokenized once and kept in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.at(tokenizer)
        for batch in batches:
            ids = tok.encode(batch.column("text"), end_id)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary())], ["doc_id", "row", "ids"])

    coded = map_batches(rows.withColumn("row", F.monotonically_increasing_id()), run, "doc_id long, row long, ids binary")
    return save(coded, "ids").withColumn("block", F.pmod(F.xxhash64("row", "doc_id"), F.lit(blocks)))
