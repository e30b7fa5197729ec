"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every run of w consecutive k-gram hashes the smallest (the
last of equals) is a fingerprint, so each shared span of k + w - 1 = WINDOW words has one in
common. Fingerprint hits are extended word by word to the whole shared run; a run of WINDOW
words or more marks its words as hit. Items of fewer words have one window, the whole item,
found with w lowered to its length.

The benchmark's fingerprints and words go to every task while the benchmark has at most
MOST_WORDS words; beyond that, fingerprints of both sides are joined by Spark and only
documents with a hit meet the items they hit.

Cases: null or empty texts have no words and are clean. Repeated items with one item_id count
once. Equal items with different ids all count. Repeated documents get a row each. Texts of any
length are cut whole. Of equal smallest hashes in a window the last is taken, on both sides alike,
so ties lose no span. Empty tables: no documents give an empty result, no items leave all
documents clean. Only doc_id, item_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, grams, map_slices, raw, stored, table

WINDOW = 13
GRAM = 5
#: Most benchmark words that are sent to each task.
MOST_WORDS = 2_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Separators (ASCII but digits and letters) become spaces, capitals small letters.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash, the last of equals, in each run of w hashes."""
    if len(h) < w:
        return np.empty(0, np.int64)
    run = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(run)) + w - 1 - run.argmin(1))


def shape(n_words: int) -> tuple[int, int, int]:
    """(span, k, w) by which an item of so many words is found."""
    span = min(n_words, WINDOW)
    k = min(GRAM, span)
    return span, k, span - k + 1


class Items:
    """A benchmark's items with their fingerprints."""

    def __init__(self, items: list[tuple[str, bytes | None]]):
        hashes = WordHash()
        self.words = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.by_shape: dict[tuple[int, int, int], dict[int, list[tuple[int, int]]]] = {}
        for n, (_, words) in enumerate(self.words):
            s = shape(len(words))
            g = grams(hashes.of(words), s[1])
            places = self.by_shape.setdefault(s, {})
            for p in winnow(g, s[2]).tolist():
                places.setdefault(int(g[p]), []).append((n, p))
        self.known = {s: np.array(sorted(x), np.uint64) for s, x in self.by_shape.items()}

    def hits(self, words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words of a document stand in an occurrence of a window, and the items these come from."""
        mark, found = np.zeros(len(words) + 1, np.int32), set()
        for s, known in self.known.items():
            span, k, w = s
            g = grams(h, k)
            at = winnow(g, w)
            if not len(at):
                continue
            place = np.searchsorted(known, g[at])
            place[place == len(known)] = 0
            done: dict[tuple[int, int], int] = {}
            for p in at[known[place] == g[at]].tolist():
                for n, q in self.by_shape[s][int(g[p])]:
                    line = (n, p - q)
                    if done.get(line, -1) > p:
                        continue
                    item, a, b = self.words[n][1], 0, 0
                    while a < min(p, q) and words[p - a - 1] == item[q - a - 1]:
                        a += 1
                    most = min(len(words) - p, len(item) - q)
                    while b < most and words[p + b] == item[q + b]:
                        b += 1
                    done[line] = p + max(b, 1)
                    if a + b >= span:
                        mark[p - a] += 1
                        mark[p + b] -= 1
                        found.add(self.words[n][0])
        return np.cumsum(mark[:-1]) > 0, found


def verdict(n_words: int, n_hit: int, items: set[str]) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def scan_slice(items: list[tuple[str, bytes | None]]):
    def make():
        bench, hashes = Items(items), WordHash()

        def run(batch: pa.RecordBatch) -> dict:
            out = []
            for t in raw(batch.column("text")):
                words = words_of(t)
                hit, found = bench.hits(words, hashes.of(words))
                out.append(verdict(len(words), int(hit.sum()), found))
            n_words, n_hit, n_items, sha, bad = zip(*out, strict=True)
            return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items_sha256": sha, "contaminated": bad}

        return run

    return make


def scanned(docs: DataFrame, benchmark: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """One row of SCHEMA per document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if size["b"] // 2 + size["n"] <= most_words:
        return map_slices(docs, scan_slice([(i or "", t.encode() if t is not None else None) for i, t in items.collect()]), SCHEMA)
    return joined(docs, items)


def prints_slice(shapes: list[tuple[int, int, int]] | None):
    """Rows (key, id, form): fingerprints of a text under its own shape (None) or under all the given ones."""

    def make():
        hashes = WordHash()

        def run(batch: pa.RecordBatch) -> dict:
            keys, ids, forms = [], [], []
            for i, t in zip(batch.column("id").to_pylist(), raw(batch.column("text")), strict=True):
                words = words_of(t)
                h = hashes.of(words)
                for s in shapes if shapes is not None else [shape(len(words))] if words else []:
                    g = grams(h, s[1])
                    at = np.unique(g[winnow(g, s[2])]).view(np.int64)
                    keys.append(at)
                    ids += [i] * len(at)
                    forms += [s[0]] * len(at)
            return {"key": np.concatenate(keys) if keys else np.empty(0, np.int64), "id": ids, "form": forms}

        return run

    return make


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As scanned(), for a benchmark of any size: fingerprints meet in a join, then each document meets the items it shares one with."""
    items = stored(items.where("text is not null").select(F.coalesce("item_id", F.lit("")).alias("id"), "text"), "items")
    marks = stored(map_slices(items, prints_slice(None), "key long, id string, form int"), "marks")
    shapes = [shape(r["form"]) for r in marks.select("form").distinct().collect()]  # at most WINDOW of them
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    own = map_slices(docs.select(F.col("row").alias("id"), "text"), prints_slice(shapes), "key long, id long, form int")
    pairs = own.withColumnRenamed("id", "row").join(marks, ["key", "form"]).select("row", "id").distinct()

    def extend(rows):
        for part in rows:
            outs = []
            for row, text, item, words in zip(*(part.column(c).to_pylist() for c in ("row", "text", "id", "item")), strict=True):
                bench, w = Items([(item, words.encode())]), words_of(text.encode())
                hit, found = bench.hits(w, WordHash().of(w))
                if found:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    outs += [(row, item, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            cols = list(zip(*outs, strict=True)) if outs else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["row", "item", "a", "b"])

    runs = pairs.join(docs.select("row", "text"), "row").join(items.select("id", F.col("text").alias("item")), "id").select("row", "text", "id", "item").mapInArrow(extend, "row long, item string, a long, b long")
    runs = stored(runs, "runs")
    from pyspark.sql import Window

    before = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0))))
    n_hit = runs.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    names = runs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("names"))
    count = map_slices(docs.select("row", "doc_id", "text"), words_slice, "row long, doc_id long, n_words long")
    out = count.join(n_hit, "row", "left").join(names, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def words_slice():
    return lambda b: {"row": b.column("row"), "doc_id": b.column("doc_id"), "n_words": [len(words_of(t)) for t in raw(b.column("text"))]}


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    bad = scanned(docs, benchmark).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
