"""Bitmaps of fixed size over hashes: built on executors, small enough to broadcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (2 MB); more set bits only cost time.
BITMAP_BITS = 1 << 24


def positions(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITMAP_BITS - 1)).astype(np.int32)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = positions(h)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def bitmap_of(places: DataFrame) -> bytes:
    """``position`` (int, below BITMAP_BITS) as a bitmap: blocks are filled on executors; the driver gets at most 2 MB."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[pdf["position"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"block": [int(key[0])], "bits": [np.packbits(bits).tobytes()]})

    rows = places.distinct().groupBy(F.shiftright("position", 16).alias("block")).applyInPandas(fill, "block int, bits binary").collect()
    out = bytearray(BITMAP_BITS >> 3)
    for r in rows:
        out[r["block"] << 13 : (r["block"] + 1) << 13] = r["bits"]
    return bytes(out)
