"""Vector code compression: product quantisation whose assignments are carried over by norm-of-sum bounds.

Components become whole numbers, vectors are cut into PARTS consecutive parts, and each part
position has a codebook of up to ENTRIES entries that ROUNDS rounds of assignment and averaging
refine. All codebooks of all rounds are kept (they are small: ENTRIES numbers per component).

The first assignment compares a part with every entry, and notes with it the squared distance
of the nearest other entry and the round of that codebook, the bound's stamp. In a later round
the part's own entry is measured exactly; any other entry j is at least as far as the noted
distance less the true displacement |C_now[j] - C_stamp[j]|, the norm of the sum of its moves
since the stamp, which is never more than the sum of their norms. Where the own entry is nearer
than that, the code stands and the bound keeps its stamp; else the part is scanned anew against
all entries and stamped with the present round. Distances are whole numbers and the comparison
leaves a margin for the roots, so codes are those of a full scan, ties to the lower index.

Rows, codes, bounds and stamps are a written table in each round, read by the next; only
codebooks and their sums (ENTRIES x dimension numbers) come to the driver.

Cases: rows with a null vector, or with null or non-finite components, are dropped. The kept
vector that comes first by vec_id (nulls last, ties by its components) sets the length; vectors
of another length stay with a null code and error. A length that PARTS does not divide gives the
first parts one component more. Components beyond +-MOST count as +-MOST, so that errors fit a
long. Fewer than ENTRIES vectors make smaller codebooks. Repeated vec_ids and vectors get a row
each. Null labels are one label. An empty table gives an empty result. Only vec_id, embedding
and label are read, so extra columns do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MOST = 256, 1 << 26
#: Rows of a batch that are compared with all entries at a time.
BLOCK = 2048
#: Relative margin for the rounding of roots.
MARGIN = 1e-9
STATE = "vec_id long, label int, x array<int>, code binary, other array<long>, stamp binary, error long, scanned int"


def cuts(dimension: int) -> list[int]:
    """Where the parts begin and end."""
    small, longer = divmod(dimension, PARTS)
    return [0, *np.cumsum([small + (p < longer) for p in range(PARTS)]).tolist()]


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index) and the least squared distance of another entry."""
    code, other = np.empty(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for a in range(0, len(x), BLOCK):
        d = np.zeros((len(x[a : a + BLOCK]), len(book)), np.int64)
        for i in range(book.shape[1]):
            d += (x[a : a + BLOCK, i, None] - book[None, :, i]) ** 2
        code[a : a + BLOCK] = best = d.argmin(1)
        if len(book) > 1:
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            other[a : a + BLOCK] = d.min(1)
    return code, other


def displacement(now: np.ndarray, then: np.ndarray) -> np.ndarray:
    """For each entry the farthest that any other entry has come from its place in `then`."""
    moved = np.sqrt(((now - then) ** 2).sum(1).astype(np.float64))
    if len(moved) < 2:
        return np.zeros(len(moved))
    first, second = np.argsort(-moved, kind="stable")[:2]
    return np.where(np.arange(len(moved)) == first, moved[second], moved[first])


def reassigned(x: np.ndarray, code: np.ndarray, other: np.ndarray, stamp: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, bounds and stamps of one part position after the last codebook of history, and which rows were scanned."""
    now = history[-1]
    own = np.sqrt(((x - now[code]) ** 2).sum(1).astype(np.float64))
    drift = np.stack([displacement(now, h) for h in history])[stamp, code]
    sure = own + drift < np.sqrt(other.astype(np.float64)) * (1 - MARGIN) - MARGIN
    rows = np.flatnonzero(~sure)
    if len(rows):
        code, other, stamp = code.copy(), other.copy(), stamp.copy()
        code[rows], other[rows] = scanned(x[rows], now)
        stamp[rows] = len(history) - 1
    return code, other, stamp, ~sure


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bytes_of(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * PARTS).astype(np.int32)), pa.py_buffer(values.tobytes())])


def assign(rows: DataFrame, history: list[list[np.ndarray]], at: list[int], first: bool) -> DataFrame:
    """rows of STATE after the last codebooks; history: all codebooks by round and part position."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column("x"), at[-1]).astype(np.int64)
            if first:
                got = [(*scanned(x[:, at[p] : at[p + 1]], history[0][p]), np.zeros(n, np.int64), np.ones(n, bool)) for p in range(PARTS)]
            else:
                code, stamp = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64) for c in ("code", "stamp"))
                other = matrix(b.column("other"), PARTS)
                got = [reassigned(x[:, at[p] : at[p + 1]], code[:, p], other[:, p], stamp[:, p], [h[p] for h in history]) for p in range(PARTS)]
            code, other, stamp, done = (np.stack(v, 1) for v in zip(*got, strict=True))
            error = sum(((x[:, at[p] : at[p + 1]] - history[-1][p][code[:, p]]) ** 2).sum(1) for p in range(PARTS))
            columns = {"code": bytes_of(code), "other": listed(other, pa.int64()), "stamp": bytes_of(stamp), "error": pa.array(error, pa.int64()), "scanned": pa.array(done.sum(1), pa.int32())}
            columns |= {c: b.column(c) for c in ("vec_id", "label", "x")}
            names = [f.split()[0] for f in STATE.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return rows.mapInArrow(run, STATE)


def sums(rows: DataFrame, at: list[int], entries: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the parts at each used entry, by part position * entries + entry."""
    width = max(b - a for a, b in zip(at, at[1:], strict=False))

    def run(batches):
        total, count = np.zeros((PARTS * entries, width), np.int64), np.zeros(PARTS * entries, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), at[-1])
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, PARTS)
                for p in range(PARTS):
                    slot = code[:, p].astype(np.int64) + p * entries
                    count += np.bincount(slot, minlength=len(count))
                    for i in range(at[p + 1] - at[p]):
                        np.add.at(total[:, i], slot, x[:, at[p] + i])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), listed(total[used], pa.int64())], names=["slot", "n", "total"])

    each = rows.select("x", "code").mapInArrow(run, "slot int, n long, total array<long>")
    got = each.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width))).collect()
    return {r["slot"]: (r["n"], [r[f"t{i}"] for i in range(width)]) for r in got}


def moved(books: list[np.ndarray], total: dict[int, tuple[int, list[int]]]) -> list[np.ndarray]:
    """The codebooks with each used entry at its parts' mean, rounded down."""
    out = [b.copy() for b in books]
    for slot, (n, t) in total.items():
        p, e = divmod(slot, len(books[0]))
        out[p][e] = [v // n for v in t[: out[p].shape[1]]]
    return out


def compressed(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code binary, error, scanned: parts that took an exact scan in the last assignment) and the final codebooks."""
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("int"))
    kept = kept.where("e is not null and forall(e, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    kept = kept.select("vec_id", "label", F.expr(f"transform(e, v -> cast(greatest(-{MOST}d, least({MOST}d, floor({SCALE}d * v))) as int))").alias("x"))
    start = [r["x"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()]
    if not start:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("int").alias("scanned")), [np.zeros((0, 0), np.int64)] * PARTS
    dimension = len(start[0])
    at, fitting = cuts(dimension), kept.where(F.size("x") == dimension)
    start = [r["x"] for r in fitting.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()]
    start = np.array(start, np.int64).reshape(len(start), dimension)
    history = [[start[:, a:b] for a, b in zip(at, at[1:], strict=False)]]
    rows = fitting
    for k in range(ROUNDS + 1):
        rows = stored(assign(rows, list(history), at, k == 0), f"vectors{k}")
        if k < ROUNDS:
            history.append(moved(history[-1], sums(rows, at, len(start))))
    other = kept.where(F.size("x") != dimension).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("int").alias("scanned"))
    return rows.select("vec_id", "label", "code", "error", "scanned").union(other), history[-1]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with the error of each and of its label. The sums by label are joined by Spark, which sends them to tasks only while they are small and else splits a hot label."""
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()
    by = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(by, rows["label"].eqNullSafe(by["of"]))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
