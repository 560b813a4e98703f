"""Content-defined chunking with a rolling hash, over whole arrays at once.

A byte decides over the hash for as many steps as the hash has bits, since every step shifts it left
by one.  The hash at every position is therefore a sum of 16 shifted table lookups, which NumPy adds
up for the whole file; only the few positions after a cut, where the hash starts anew, differ.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# They decide where files are cut, and so which chunks stores can share.
MIN_SIZE = 8 * 1024
AVERAGE_SIZE = 16 * 1024
MAX_SIZE = 256 * 1024
STRICT_BITS = 16
LOOSE_BITS = 12
HASH_BITS = 16
GEAR_SEED = 0xA5A5_5A5A_C3C3_3C3C
FIXED_FROM = 64 * 1024 * 1024

_random = random.Random(GEAR_SEED)
GEAR = np.array([_random.getrandbits(64) & ((1 << HASH_BITS) - 1) for _ in range(256)], dtype=np.uint32)
GEAR16 = GEAR.astype(np.uint16)


@dataclass(frozen=True)
class Cuts:
    """Sizes and bits that decide over cuts."""

    least: int = MIN_SIZE
    average: int = AVERAGE_SIZE
    most: int = MAX_SIZE
    strict_bits: int = STRICT_BITS
    loose_bits: int = LOOSE_BITS


#: Bytes hashed at once, so that the sums stay in a core's cache.
BLOCK = 1 << 16


def hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, as if it had started long before.

    A sum over 2k bytes is the sum over the last k plus that over the k before, shifted by k, so four
    rounds of doubling cover the 16 bytes that a hash depends on; 16-bit sums drop what is beyond.
    """
    out = np.empty(len(data), dtype=np.uint16)
    for start in range(0, len(data), BLOCK):
        head = max(0, start - HASH_BITS + 1)
        sums, width = GEAR16[data[head : start + BLOCK]], 1
        while width < HASH_BITS:
            wider = sums.copy()
            wider[width:] += sums[:-width] << np.uint16(width) if len(sums) > width else 0
            sums, width = wider, 2 * width
        out[start : start + BLOCK] = sums[start - head :]
    return out


def cut_points(data: bytes, cuts: Cuts = Cuts()) -> list[int]:
    """Where chunks end.  No cut lies in the first ``least`` bytes of a chunk; up to the average size
    a cut needs more zero bits of the hash than beyond; the largest size cuts anyway."""
    size = len(data)
    if size == 0:
        return []
    if size >= FIXED_FROM:
        return [*range(cuts.most, size, cuts.most), size]
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled = hashes(raw)
    strict, loose = np.uint16((1 << cuts.strict_bits) - 1), np.uint16((1 << cuts.loose_bits) - 1)
    strict_at, loose_at = np.flatnonzero((rolled & strict) == 0), np.flatnonzero((rolled & loose) == 0)
    out, start = [], 0
    while size - start > cuts.least:
        first = start + cuts.least
        middle, last = min(start + cuts.average, size), min(start + cuts.most, size)
        warm = min(first + HASH_BITS - 1, last)  # here the hash hasn't yet seen all its bytes
        end, running = 0, 0
        for i in range(first, warm):
            running = ((running << 1) + int(GEAR[raw[i]])) & ((1 << HASH_BITS) - 1)
            if running & int(strict if i < middle else loose) == 0:
                end = i + 1
                break
        if not end:
            i = np.searchsorted(strict_at, warm)
            if i < len(strict_at) and strict_at[i] < middle:
                end = int(strict_at[i]) + 1
            else:
                i = np.searchsorted(loose_at, max(warm, middle))
                end = int(loose_at[i]) + 1 if i < len(loose_at) and loose_at[i] < last else last
        out.append(end)
        start = end
    if start < size:
        out.append(size)
    return out


def chunks_of(data: bytes, cuts: Cuts = Cuts()) -> list[bytes]:
    """The chunks of a file."""
    ends = cut_points(data, cuts)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_files(files: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(node_id, relpath, ordinal, data) from (node_id, relpath, content): the chunks of each file, an
    empty file having none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node_id, relpath, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts = chunks_of(content or b"", cuts)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([node_id] * len(parts)), pa.array([relpath] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["node_id", "relpath", "ordinal", "data"])

    return files.select("node_id", "relpath", "content").mapInArrow(run, "node_id string, relpath string, ordinal int, data binary")


def fixed_chunks(files: DataFrame, size: int = MAX_SIZE) -> DataFrame:
    """The same from cuts at fixed distances, without leaving the JVM."""
    length = F.octet_length("content")
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    flat = files.select("node_id", "relpath", "content", F.posexplode(starts).alias("ordinal", "start"))
    return flat.select("node_id", "relpath", "ordinal", F.substring("content", F.col("start") + 1, F.lit(size)).alias("data"))
