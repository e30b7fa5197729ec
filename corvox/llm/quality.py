"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text is measured once (words, symbols, repeated lines, repeated word windows). The
rates go into histogram sketches per language and source: a value is put in one of a fixed
set of buckets whose width is at most 1/128 of the value, and a sketch is the count of each
bucket, so sketches are merged by adding counts, whatever the order. Each source's sketch is
merged with its language's and the corpus's, both weighted as PRIOR rows: a source of few rows
leans on them, one of many goes its own way, by one rule at every size. The quartile fences of
the merged sketch are the rates that a group allows. Where most documents of a group have none
of a thing, so that its quartiles are 0, the sketch's own count model gives the rate: the odds
of having any, over the mean length; how much the others have, junk say, does not move it. A
document is rejected where its count lies beyond what that rate gives for its length by more
than SIGMAS standard deviations of such a count and one more (control limits): short texts are
not judged by chance, and long ones may have as much as their length explains. Documents are
joined with their group's thresholds and filtered.

Cases: null text counts as empty (no words; base_failed). Null lang or source form groups of
their own. Repeated rows and ties are measured and kept or rejected alike, one result row each.
Texts of any length are measured whole. An empty table gives an empty result. Only doc_id,
text, lang and source are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_slices, raw, stored, table

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
#: Words a document needs, and percent of its words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Rows that the language's and the corpus's sketch weigh in a source's; weights are whole numbers of 1 / UNIT rows.
PRIOR, UNIT = 50, 1000
#: Rates are whole numbers in so many words or lines.
PER = 1_000_000
#: Fences lie FENCE quartile distances beyond the quartiles; a count may pass them by SIGMAS standard deviations.
FENCE, SIGMAS = 3, 3
#: Counted things and what they are counted against; `low` ones are too few below a fence.
MEASURES = {"symbols": ("n_symbols", "n_words"), "lines": ("n_dup_lines", "n_lines"), "chars": ("word_chars", "n_words")}
LIMITS = [("symbols", "high"), ("lines", "high"), ("chars", "high"), ("chars", "low")]
SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that stand in a WINDOW-word window found twice or more in it. ids, doc: word number and document of each word."""
    n = len(ids) - WINDOW + 1
    out = np.zeros(n_docs, np.int64)
    if n <= 0:
        return out
    inside = doc[:n] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    h = doc[at].astype(np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[at + i] + 1).astype(np.uint64)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return out
    twin = np.zeros(len(at), bool)
    groups = np.split(order, np.flatnonzero(~same) + 1) if same.any() else []
    for g in groups:
        if len(g) < 2:
            continue
        w = np.stack([ids[at[g] + i] for i in range(WINDOW)] + [doc[at[g]]], 1)  # equal hashes are compared word by word
        if (w == w[0]).all():
            twin[g] = True
        else:
            _, back, n_of = np.unique(w, axis=0, return_inverse=True, return_counts=True)
            twin[g] = n_of[back.ravel()] > 1
    mark = np.zeros(len(ids) + WINDOW, np.int32)
    hit = at[twin]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WINDOW, -1)
    covered = np.cumsum(mark[: len(ids)]) > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def measure_slice():
    def run(batch: pa.RecordBatch) -> dict:
        from collections import defaultdict
        from itertools import count

        texts = [x or b"" for x in raw(batch.column("text"))]
        number = defaultdict(count().__next__)
        ids, n_words, chars, symbols, lines, dups = [], [], [], [], [], []
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        for t, n in zip(texts, points, strict=True):
            words = t.split()
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            n_words.append(len(words))
            chars.append(n - sum(t.count(c) for c in SPACES))
            symbols.append(sum(t.count(c) for c in SYMBOLS))
            seen = [x for x in t.split(b"\n") if x.strip(SPACES)]
            lines.append(len(seen))
            dups.append(len(seen) - len(set(seen)))
        doc = np.repeat(np.arange(len(texts)), n_words)
        return {
            "doc_id": batch.column("doc_id").cast(pa.int64()), "lang": batch.column("lang"), "source": batch.column("source"),
            "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_lines": lines, "n_dup_lines": dups,
            "n_repeat_words": repeated(np.concatenate(ids), doc, len(texts)),
        }

    return run


def measured(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA per document."""
    keep = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string").alias("text"))
    return map_slices(keep, measure_slice, SCHEMA).withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def rate(measure: str) -> str:
    """A count as a whole number in PER."""
    count, of = MEASURES[measure]
    return f"({PER} * {count} div greatest({of}, 1))"


def bucket(x: str) -> str:
    """The lower edge of a value's bucket: values below 256 stand for themselves, others keep their eight leading bits."""
    return f"(case when {x} < 256 then {x} else ({x} div shiftleft(1L, length(bin({x})) - 8)) * shiftleft(1L, length(bin({x})) - 8) end)"


def sketches(rows: DataFrame) -> DataFrame:
    """Sketch rows (measure, lang, source, bucket, n, size: words or lines of these n) of every language and source."""
    each = rows.where("not base_failed").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.expr(rate(m)).alias("x"), F.expr(f"greatest({of}, 1)").alias("of")) for m, (_, of) in MEASURES.items()))).alias("m")).select("lang", "source", "m.*")
    return each.groupBy("measure", "lang", "source", F.expr(bucket("x")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("of").alias("size"))


def merged(sketch: DataFrame) -> DataFrame:
    """Each source's sketch with its language's and the corpus's, each of these weighted as PRIOR rows: rows (measure, lang, source, bucket, n, size)."""
    groups = sketch.select("measure", "lang", "source").distinct()
    by = lambda *keys: sketch.groupBy("measure", *keys, "bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    share = lambda part, *keys: part.withColumn("total", F.sum("n").over(Window.partitionBy("measure", *keys))).withColumns({c: F.expr(f"{c} * {PRIOR * UNIT} div total") for c in ("n", "size")})
    language, corpus = share(by("lang"), "lang"), share(by())
    g = groups.alias("g")
    same = (F.col("g.measure") == F.col("p.measure")) & F.col("g.lang").eqNullSafe(F.col("p.lang"))
    parts = sketch.select("measure", "lang", "source", "bucket", *((F.col(c) * UNIT).alias(c) for c in ("n", "size")))
    parts = parts.union(g.join(language.alias("p"), same).select("g.*", "p.bucket", "p.n", "p.size"))
    parts = parts.union(g.join(corpus.alias("p"), F.col("g.measure") == F.col("p.measure")).select("g.*", "p.bucket", "p.n", "p.size"))
    return parts.groupBy("measure", "lang", "source", "bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


#: Rate of the count model: odds of having any, over the mean length.
MODEL = f"floor({PER} * others / zeros * n / size)"


def fences(sketch: DataFrame) -> DataFrame:
    """Allowed rates (lang, source, a column per measure and side) of every group. A sketch has at most some 5,000 buckets, so the windows are small."""
    w = Window.partitionBy("measure", "lang", "source")
    run = merged(sketch).withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
    total = lambda c, ok: F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("double")
    q = run.groupBy("measure", "lang", "source").agg(at(25).alias("q1"), at(75).alias("q3"), total("n", F.col("bucket") == 0).alias("zeros"), total("n", F.col("bucket") > 0).alias("others"), total("n", F.lit(True)).alias("n"), total("size", F.lit(True)).alias("size"))
    q = q.withColumns({"low": F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), "high": F.when(F.col("q3") > 0, F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).otherwise(F.expr(MODEL).cast("long"))})
    return q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, side in LIMITS))


def beyond(measure: str, side: str) -> str:
    """Whether a document's count lies beyond its group's allowed rate by more than SIGMAS standard deviations; all in parts of PER."""
    count, of = MEASURES[measure]
    allowed = f"({measure}_{side} * {of})"
    gap = f"({PER} * {count} - {allowed})" if side == "high" else f"({allowed} - {PER} * {count})"
    return f"coalesce({gap} > 0 and cast({gap} as double) * cast({gap} as double) > {SIGMAS * SIGMAS * PER} * cast({allowed} + {PER} as double), false)"


def judged(docs: DataFrame) -> DataFrame:
    """Measures, base_failed, the group's thresholds and kept, one row per document.

    The thresholds have one row per language and source; Spark broadcasts them only while
    their size is below its threshold, and else joins by shuffle.
    """
    rows = stored(measured(docs), "quality")
    limits = fences(sketches(rows))
    on = rows["lang"].eqNullSafe(limits["lang"]) & rows["source"].eqNullSafe(limits["source"])
    both = rows.join(limits, on, "left").drop(limits["lang"]).drop(limits["source"])
    return both.withColumn("kept", F.expr("not base_failed and not (" + " or ".join(beyond(*x) for x in LIMITS) + ")"))


def filtered(docs: DataFrame) -> DataFrame:
    """docs without the documents that the rules reject."""
    gone = judged(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
