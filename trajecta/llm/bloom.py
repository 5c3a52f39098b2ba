"""A Bloom filter of bounded size over 64-bit ids.

It only decides which rows need to travel to a join: a false positive costs a
shuffled row, never a wrong result. Its size follows the number of ids, 16 bits
each, up to a fixed bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .memory import tidy
from .wordhash import mix

#: Binary logarithms of the least and the largest number of bits: 16 KB and
#: 32 MB on the driver and in each executor.
LEAST, MOST = 17, 28
SEGMENTS = 32
PROBES = 3


def places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Each id's bits in a filter of ``size`` bits, a power of two."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


class Bloom:
    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)

    def might_contain(self, ids: np.ndarray) -> np.ndarray:
        found = np.ones(len(ids), dtype=bool)
        for at in places(ids, 8 * len(self.bits)):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def build(ids: DataFrame) -> bytes:
    """The filter's bits for the one long column of ``ids``: one pass per
    partition, segments merged by OR in a shuffle and sent to the driver."""
    prepare(ids.sparkSession)
    size = 1 << min(MOST, max(LEAST, (16 * ids.count()).bit_length()))
    name, seg_bytes = ids.columns[0], size // 8 // SEGMENTS

    def partial(batches):
        bits = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            for at in places(b.column(name).drop_null().to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = [(s, bits[s * seg_bytes : (s + 1) * seg_bytes]) for s in range(SEGMENTS)]
        rows = [(s, x.tobytes()) for s, x in rows if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["segment", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(seg_bytes, dtype=np.uint8)
        for x in table.column("bits"):
            bits |= np.frombuffer(x.as_py(), dtype=np.uint8)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    schema = "segment int, bits binary"
    found = {r[0]: bytes(r[1]) for r in ids.mapInArrow(tidy(partial), schema).groupBy("segment").applyInArrow(merge, schema).collect()}
    return b"".join(found.get(s, bytes(seg_bytes)) for s in range(SEGMENTS))
