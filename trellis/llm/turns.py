"""Conversations as streams: rows of one conversation after another, in order, never held as a whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def streamed(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """df dealt by key, each task's rows in order of key, then of order; sorting spills."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, iterator of its rows) of sorted batches whose first column is the key; only a batch is held."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return groupby(rows, itemgetter(0))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows and, but for one long row, characters."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or chars >= most_chars:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Digest:
    """SHA-256 and number of characters of text that comes in parts."""

    def __init__(self) -> None:
        self._sha, self.chars = hashlib.sha256(), 0

    def add(self, *parts: str) -> None:
        for p in parts:
            self._sha.update(p.encode())
            self.chars += len(p)

    @property
    def hex(self) -> str:
        return self._sha.hexdigest()
