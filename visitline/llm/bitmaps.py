"""Filters of fixed size for sets of 64-bit hashes.

A bitmap lets every hash of its set pass, and others by chance; the fuller it is the more of these. Its
size never grows with the data, so it may go to every task: what passes wrongly is left to a later join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def bitmap_of(df: DataFrame, hashed: str, bits: int) -> np.ndarray:
    """Bitmap of ``2 ** bits`` bits over the low bits of the SQL expression ``hashed``.

    Words of 64 bits are combined in Spark; at most ``2 ** (bits - 6)`` rows reach the driver.
    """
    place = f"({hashed} & {(1 << bits) - 1}L)"
    cells = df.selectExpr(f"shiftright({place}, 6) AS cell", f"shiftleft(1L, cast({place} & 63 AS int)) AS bit")
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passing(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 hashes pass."""
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
