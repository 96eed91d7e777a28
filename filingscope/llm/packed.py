"""Counts of 64-bit keys from all over a corpus, shuffled as sorted, packed runs of keys.

A row for each key costs Spark about three times the key's information and a hash table entry. Here each task sorts the keys it has gathered,
cuts them by range into blocks and sends a block's keys as one value: their low bytes, the small steps between their high
parts, and their numbers, one byte each as a rule. A block is merged by one task; the number of blocks follows the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filingscope.llm.common import map_batches

BUFFERED_KEYS = 4_000_000
BLOCK_KEYS = 2_000_000  # keys, repeats included, that there is a block for


def pack(keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    """Different sorted unsigned keys, how often each occurs, and its value; `values` may be empty."""
    for low in (2, 3, 4, 5, 6):  # bytes sent as they are
        steps = np.diff(keys >> np.uint64(8 * low), prepend=np.uint64(0))
        if len(keys) < 2 or int(steps[1:].max()) < 1 << 16:
            break
    plain = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :low]
    many = counts >= 255
    head = np.array([low, len(keys), int(many.sum()), int(steps[0]) if len(keys) else 0], np.int64)
    parts = (head, steps[1:].astype(np.uint16), np.ascontiguousarray(plain.T), np.where(many, 255, counts).astype(np.uint8), counts[many].astype(np.int64), values.astype(np.int64))
    return b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, n, many, first = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    steps = np.frombuffer(data, np.uint16, max(0, n - 1), at)
    at += steps.nbytes
    plain = np.frombuffer(data, np.uint8, low * n, at).reshape(low, n)
    at += plain.nbytes
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(data[at : at + 8 * many], np.int64)
    values = np.frombuffer(data[at + 8 * many :], np.int64)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :low] = plain.T
    high = np.cumsum(np.r_[np.uint64(first), steps.astype(np.uint64)][:n], dtype=np.uint64)
    return whole.view(np.uint64).ravel() + (high << np.uint64(8 * low)), counts, values


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, sorted, their summed counts and their values."""
    keys, counts, values = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, values[order[first]] if len(values) else values


def counted(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray | tuple[np.ndarray, np.ndarray]], expected: int, least: int, valued: bool = False
) -> DataFrame:
    """key and n of the keys of all rows that occur `least` times; `expected` is about how many keys there are, repeats included.

    With `valued`, `keys_of` gives keys and values, and the rows have the `value` of each key, which must not differ for a key.
    """
    blocks = max(1, -(-expected // BLOCK_KEYS))
    names, schema = (["key", "n", "value"], "key long, n long, value long") if valued else (["key", "n"], "key long, n long")

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *(h[0].view(np.uint64) for h in held)])
        if valued:
            keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
            values = np.concatenate([np.zeros(0, np.int64), *(h[1] for h in held)])[at]
        else:
            keys, counts = np.unique(keys, return_counts=True)
            values = np.zeros(0, np.int64)
        # The high half of a key times the number of blocks: ranges of equal size.
        block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(keys)]
        data = [pack(keys[a:b], counts[a:b], values[a:b]) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = keys_of(batch)
            held.append(found if valued else (found,))
            size += len(held[-1][0])
            if size > BUFFERED_KEYS:
                yield sent(held)
                held, size = [], 0
        yield sent(held)

    def result(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts, values = _merged(parts)
        keep = counts >= least
        columns = [pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])] + ([pa.array(values[keep])] if valued else [])
        return pa.RecordBatch.from_arrays(columns, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own = [], None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != own and parts:
                    yield result(parts)
                    parts = []
                own = block
                parts.append(unpack(data.as_buffer().to_pybytes()))
        if parts:
            yield result(parts)

    packed = map_batches(rows, run, "block long, data binary").repartition(blocks, "block").sortWithinPartitions("block")
    return map_batches(packed, merge, schema)
