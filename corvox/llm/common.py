"""Shared helpers of the training-data operators: scratch tables, bounded Arrow slices, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corvox.operators import loops
from corvox.sources.scratch import scratch, stored  # noqa: F401

#: Text bytes handled at a time inside a task; a single longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the named column holds about `limit` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """df through a function of bounded slices. `make` runs once in each task and returns the function, which maps a slice to columns."""

    def run(batches):
        each, out = make(), None
        for part in slices(batches, text, limit):
            got = each(part)
            out = out or arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type, from_pandas=False) for f in out for a in (got[f.name],)], schema=out)

    return df.mapInArrow(run, schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as 'doc_id long, text string'."""
    return pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in schema.split(","))])


def raw(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values spread evenly."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordHash(dict):
    """64-bit hash of a word, kept for words seen before; emptied when it has grown to `limit` entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier that makes the hash of a word sequence depend on order.
STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * STEP + h[i : i + n]
    return mix(out)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of edges(a, b): columns node, component (the smallest node that links reach)."""
    return loops.components(edges, tag, by=())
