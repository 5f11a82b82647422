"""Bloom filters of a bounded size, built in segments: a value has two places in the segment that its leading bits name.

A segment's owner sees all values of the segment, so it can tell places seen once from places seen twice. No value is
lost; beyond MOST_BITS a filter only lets more values through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, partitions

SEGMENT_BITS = 20
#: 64 MiB, the most that a task or the driver holds of one filter.
MOST_BITS = 1 << 29
_HELD = 1 << 17


def size_for(values: int) -> int:
    """Bits for that many values: 16 a value at least, up to MOST_BITS; a power of two."""
    return min(MOST_BITS, max(1 << SEGMENT_BITS, 1 << (16 * max(1, values) - 1).bit_length()))


def _segment(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(1)) // U64((1 << 63) // (bits >> SEGMENT_BITS))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = U64((1 << SEGMENT_BITS) - 1)
    return (h & low).astype(np.int64), ((h >> U64(SEGMENT_BITS)) & low).astype(np.int64)


class Bits:
    """A filter as the tasks read it."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        """For each 64-bit hash whether both its places are set."""
        base = _segment(h, self.bits).astype(np.int64) << SEGMENT_BITS
        first, second = _places(h)
        found = np.ones(len(h), bool)
        for place in (base + first, base + second):
            found &= (self.packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return found


def _owner(bits: int, times: int):
    def run(batches):
        seen: dict[int, np.ndarray] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put():
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            segment = _segment(h, bits)
            order = np.argsort(segment, kind="stable")
            edge = np.flatnonzero(np.diff(segment[order])) + 1
            for part in np.split(order, edge):
                if not len(part):
                    continue
                counts = seen.setdefault(int(segment[part[0]]), np.zeros(1 << SEGMENT_BITS, np.uint8))  # 0, 1 or 2 = more
                first, second = _places(h[part])
                place, count = np.unique(np.concatenate([first, second]).repeat(np.tile(np.minimum(n[part], 2), 2)), return_counts=True)
                counts[place] = np.minimum(2, counts[place] + np.minimum(count, 2))

        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= _HELD:
                put()
                rows = 0
        if held:
            put()
        for segment, counts in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([np.packbits(counts >= times, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"]
            )

    return run


def build(values: DataFrame, bits: int, times: int = 1) -> Bits:
    """values(h long, n long) -> the filter of the places that are seen at least `times` (1 or 2) times. n: how often a
    row counts. The driver gets one bit for each place, at most MOST_BITS / 8 bytes. Runs a job."""
    segments = bits >> SEGMENT_BITS
    share = F.expr(f"shiftrightunsigned(h, 1) div {(1 << 63) // segments}L") if segments > 1 else F.lit(0)
    owners = max(1, min(segments, max(partitions(values.sparkSession), segments // 64)))
    dealt = values.select("h", F.col("n").cast("long")).repartition(owners, share)
    packed = np.zeros(bits >> 3, np.uint8)
    width = 1 << (SEGMENT_BITS - 3)
    for row in dealt.mapInArrow(_owner(bits, times), "segment int, bits binary").toLocalIterator():
        packed[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return Bits(bits, packed)
