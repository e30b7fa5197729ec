"""Harmonic packing of token sequences.

Documents that fit a sequence fall in reciprocal-capacity classes: class k holds lengths above
capacity / (k + 1), up to capacity / k, and a bin of it is complete with k documents. A worker
holds one open bin a class and needs nothing from other workers, so there is no shuffle. Longer
documents have to be cut anyway: their ids are the filling. A complete bin whose documents
leave room waits for filling of just that length; filling that no bin waits for becomes whole
sequences. If too many bins wait, the one with most room is taken apart and fills the others.
What a worker holds at its end becomes sequences of power-of-two length, which need no padding.

Cases: null or empty text is the end id alone. Repeated documents are packed each. Documents of
equal length tie and stay in the order read. Texts of any length are cut into as many pieces as
it takes. An empty table gives an empty result; extra columns, whatever their names, are not
read. sequence_id is the partition's number times 2^40 plus a running number in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, slices, table

CAPACITY, END = 2048, 1
#: Bins that wait for filling, and sequences of filling kept for them, in a worker.
WAITING, RESERVE = 512, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters whose class no version of the Unicode tables disputes.
PLAIN = re.compile("[\t\n\r -~\xa0-\u024f\u2010-\u2027\u20ac]*+")


class Encoder:
    """Token ids of texts as little-endian bytes, as the file's tokenizer gives them.

    With the same vocabulary as a rank file and its split pattern, texts of plain characters
    and without a special token's string take the faster merge of the rank library, which
    gives the same ids; all others are encoded by the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        fast = [self.fast is not None and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.tokenizer.encode_batch([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if f else np.array(next(rest).ids, "<u4").tobytes() for t, f in zip(texts, fast, strict=True)]


class Bins:
    """A worker's open bins, waiting bins and filling. A piece is (doc, start, ids, doc tokens)."""

    def __init__(self, base: int, capacity: int = CAPACITY, waiting: int = WAITING, reserve: int = RESERVE):
        self.base, self.capacity, self.most, self.reserve = base, capacity, waiting, reserve * capacity
        self.open: dict[int, list] = {}
        self.waiting: list[tuple[int, list]] = []  # (room, pieces), least room first
        self.filling: deque = deque()
        self.have = 0  # tokens of filling
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.base, offset))
            offset += n
        self.base += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if n > self.capacity:
            self.fill([(doc, 0, ids, n)])
            return
        k = self.capacity // n
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, 0, ids, n))
        if len(bin_) == k:
            del self.open[k]
            self.wait(bin_)

    def wait(self, pieces: list) -> None:
        room = self.capacity - sum(len(p[2]) // 4 for p in pieces)
        if not room:
            self.close(pieces)
        elif room <= self.have:
            self.close(pieces + self.take(room))
        else:
            insort(self.waiting, (room, pieces), key=lambda x: x[0])
            if len(self.waiting) > self.most:
                self.fill(self.waiting.pop()[1])

    def fill(self, pieces: list) -> None:
        """Takes pieces as filling and uses what can be used."""
        self.filling += pieces
        self.have += sum(len(p[2]) // 4 for p in pieces)
        while self.waiting and self.waiting[0][0] <= self.have:
            room, held = self.waiting.pop(0)
            self.close(held + self.take(room))
        while self.have > self.reserve:
            self.close(self.take(self.capacity))

    def take(self, n: int) -> list:
        """n tokens of filling, the last piece cut to fit."""
        out, self.have = [], self.have - n
        while n:
            doc, start, ids, total = self.filling.popleft()
            size = len(ids) // 4
            if size > n:
                self.filling.appendleft((doc, start + n, ids[4 * n :], total))
                ids, size = ids[: 4 * n], n
            out.append((doc, start, ids, total))
            n -= size
        return out

    def finish(self) -> None:
        """Packs what is left, without padding."""
        rest = [p for k in sorted(self.open) for p in self.open[k]] + [p for _, held in self.waiting for p in held]
        self.open, self.waiting, self.reserve = {}, [], self.capacity
        self.fill(rest)
        while self.have:
            self.close(self.take(min(self.capacity, 1 << (self.have.bit_length() - 1))))


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of SCHEMA of docs(doc_id, text); `tokenizer` is a file of the tokenizers library, `ranks` the same vocabulary as a rank file with its split `pattern`; executors can read both."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema, stop = arrow_schema(SCHEMA), np.array([end], "<u4").tobytes()

    def flush(bins: Bins) -> pa.RecordBatch:
        columns = list(zip(*bins.out, strict=True)) or [[]] * len(schema)
        bins.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        encoder, bins = None, Bins(TaskContext.get().partitionId() << 40, capacity)
        for part in slices(batches, "text", 2 << 20):
            encoder = encoder or Encoder(tokenizer, ranks, pattern)
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                bins.add(doc, ids + stop)
            yield flush(bins)
        bins.finish()
        yield flush(bins)

    return rows.mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return packed(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
