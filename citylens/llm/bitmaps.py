"""Sets of 64-bit marks as bitmaps of fixed size, for tasks that may ask for too much but never for too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bitmap:
    """The column ``mark`` of a table by its highest ``bits`` bits; ``contains`` is false only for marks that are not in it.

    The broadcast takes 2 ** (bits - 3) bytes at most, however many marks there are.
    """

    def __init__(self, table: DataFrame, bits: int):
        slots = table.select(F.shiftrightunsigned("mark", 64 - bits).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
        parts = slots.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
        self.bits, self.flat = bits, None
        self.parts = table.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in parts})

    def __getstate__(self):
        return {**self.__dict__, "flat": None}

    def contains(self, marks: np.ndarray) -> np.ndarray:
        if self.flat is None:
            # Bucket 1 holds slots 1 to 32768, bucket 0 slot 0; bit p of a byte string is bit p % 8 of byte p // 8.
            flat = np.zeros((1 << max(self.bits, 3) - 3) + 8192, np.uint8)
            for bucket, bits in self.parts.value.items():
                flat[4096 * bucket:4096 * bucket + len(bits)] = np.frombuffer(bits, np.uint8)[:len(flat) - 4096 * bucket]
            self.flat = flat
        place = (marks >> np.uint64(64 - self.bits)).astype(np.int64) + 32767
        place[place == 32767] = 0
        return (self.flat[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
