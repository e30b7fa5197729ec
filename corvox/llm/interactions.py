"""Filter interaction audit: what each order of the filters removes, and each filter's fair share of it.

Every document gets one mask of the filters it fails, and a part of the corpus is the count of
its masks, for all documents, those of good quality and toxic ones: at most 32 rows that Spark
adds up. From these follows the table of all 2^5 coalitions, v(S) being the number of documents
that the filters of S remove together. Any step of any order is a difference of two coalitions.

Shapley values are the constrained least-squares fit of an additive game to v: weights
(M - 1) / (C(M, s) s (M - s)) for coalitions of size s, efficiency (the values sum to v(all))
as a constraint. The normal equations with their multiplier are solved once in rationals, which
gives every value as an exact rational combination of the 32 coalitions; times M! they are whole.

Copies are judged by a digest of the whole text. Copies are first counted per (digest, part,
labels, doc_id), then per digest with the smallest doc_id, so that a text that a third of all
rows holds is a few counts and never a group of rows.

Cases: null text counts as empty, null source as the part with an empty name. A null doc_id is
no smaller than another and has no smaller: such rows neither fail filter E nor make others
fail. Rows that share a doc_id and text don't make each other fail. Labels of one doc_id are
taken together (quality 1 or toxic 1 in any row). Texts of any length are read whole. An empty
table gives an empty result. Only doc_id, text, source and the label columns are read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, raw, stored, table

FILTERS = "ABCDE"
M, N = len(FILTERS), 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
MEASURES = ["removed", "good_lost", "toxic_lost"]
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def judge_slice():
    def run(batch: pa.RecordBatch) -> dict:
        masks, digests = [], []
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        for t, n in zip((x or b"" for x in raw(batch.column("text"))), points, strict=True):
            words = t.split()
            capitals = len(t) - len(t.translate(None, CAPITALS))
            fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * n, len(t.translate(None, SYMBOLS)) < len(t))
            masks.append(sum(1 << i for i, f in enumerate(fails) if f))
            digests.append(hashlib.sha256(t).digest())
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "mask": masks, "digest": digests}

    return run


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts n of documents by part, mask of failed filters, good and toxic."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = stored(map_slices(rows, judge_slice, "doc_id long, part string, mask int, digest binary"), "masks")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality"), F.col("toxic")).where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "mask", "digest", *(F.coalesce(c, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    by = ["digest", "mask", "part", "good", "toxic"]
    each = rows.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("lowest")
    some = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), lowest)
    # a digest has at most 4 rows a part here
    first = some.groupBy(F.col("digest").alias("of")).agg(F.min("lowest.doc_id").alias("first"))
    some = some.join(first, F.col("digest") == F.col("of"))
    stays = F.col("nameless") + F.when(F.col("lowest.doc_id") == F.col("first"), F.col("lowest.n")).otherwise(0)
    some = some.withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("bit"), stays.alias("n")), F.struct(F.lit(1 << M - 1).alias("bit"), (F.col("n") - stays).alias("n")))))
    return some.where("e.n > 0").groupBy("part", (F.col("mask") + F.col("e.bit")).alias("mask"), "good", "toxic").agg(F.sum("e.n").alias("n"))


def solved(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of a x = b, by elimination in rationals; b has a column for each right side."""
    rows = [list(x) + list(y) for x, y in zip(a, b, strict=True)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [v - rows[i][k] * w for v, w in zip(rows[i], rows[k], strict=True)]
    return [r[len(a) :] for r in rows]


def shapley_weights(m: int = M) -> list[list[Fraction]]:
    """Row i has the weight of each coalition's v in the value of player i, from the normal equations with the efficiency constraint's multiplier."""
    inside = lambda i, s: Fraction(s >> i & 1)
    kernel = {s: Fraction(m - 1, comb(m, k := bin(s).count("1")) * k * (m - k)) for s in range(1, (1 << m) - 1)}
    left = [[2 * sum(w * inside(i, s) * inside(j, s) for s, w in kernel.items()) for j in range(m)] + [Fraction(1)] for i in range(m)] + [[Fraction(1)] * m + [Fraction(0)]]
    right = [[2 * kernel.get(s, Fraction(0)) * inside(i, s) for s in range(1 << m)] for i in range(m)] + [[Fraction(s == (1 << m) - 1) for s in range(1 << m)]]
    if m == 1:
        left, right = [[Fraction(1)]], [[Fraction(0), Fraction(1)]]
    return solved(left, right)[:m]


def steps(counts: dict[str, np.ndarray]):
    """Result rows without part, of the numbers of documents with each mask for MEASURES."""
    hits = np.array([[s & mask != 0 for mask in range(N)] for s in range(N)], np.int64)
    v = {k: (hits @ c).tolist() for k, c in counts.items()}  # v[k][S]: what the coalition S removes
    total, whole = int(counts["removed"].sum()), N - 1
    shares = [sum(w * x for w, x in zip(row, v["removed"], strict=True)) * factorial(M) for row in shapley_weights()]
    assert all(s.denominator == 1 for s in shares)
    for order in permutations(range(M)):
        before = 0
        for k, f in enumerate(order, 1):
            after = before | 1 << f
            gone = {m: v[m][after] - v[m][before] for m in MEASURES}
            yield "".join(FILTERS[i] for i in order), k, total - v["removed"][after], gone["removed"], v["removed"][1 << f] - gone["removed"], v["removed"][whole] - v["removed"][whole ^ 1 << f], gone["good_lost"], gone["toxic_lost"], int(shares[f])
            before = after


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of RESULT: every part, order and step. A part comes to a task as three arrays of 32 counts."""
    rows = masked(docs, labels)
    of = lambda m, when: F.sum(F.when((F.col("mask") == m) & when, F.col("n")).otherwise(0))
    kinds: dict[str, Column] = {"removed": F.lit(True), "good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    parts = rows.groupBy("part").agg(*(F.array(*(of(m, when) for m in range(N))).alias(k) for k, when in kinds.items()))

    def run(batches):
        schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((n, pa.int64()) for n in ("kept", *MEASURES[:1], "redundant", "unique_fails", *MEASURES[1:], "shapley"))])
        for b in batches:
            for r in b.to_pylist():
                out = list(zip(*((r["part"], *x) for x in steps({m: np.array(r[m], np.int64) for m in MEASURES})), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return parts.mapInArrow(run, RESULT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
