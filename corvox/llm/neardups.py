"""N-gram Jaccard join by signature trees, and the classes it links.

A document's set is its distinct 5-word shingles (64-bit hashes; fewer words: the whole
sequence). Two documents link when 100 * common >= 80 * joint shingles.

1. Root level. No document shares more with another than the shingles that occur elsewhere at
   all. Chunks of documents send their shingles, each once, to buckets of the hash range;
   buckets answer how many documents hold each one. A document with too few shared shingles
   has no link and leaves here. Equal word sequences go on as one.
2. Signature trees over runs of documents. Documents are sorted by the smallest of their
   shared shingles, so that most linked ones stand together, and cut into blocks of bounded
   size, each with a tree whose nodes hold the OR of their documents' bitmaps, their range of
   set sizes and the largest number of shingles that share bits. The tree is traversed against
   itself; a pair of nodes is left when the common bits, with the shared ones, cannot reach the
   overlap that their sizes need. Pairs of documents that remain are compared exactly, unless
   links found before already join them. One document of each group then takes part in another
   round by another smallest shingle, as long as a round joins one in eight or more. These
   rounds only save work; the next step is complete without them.
3. Signature trees over shingles. With shingles ordered from rare to frequent, linked documents
   have one in common among the first n - ceil(0.8 n) + 1 of each (prefix principle). Shingles
   whose documents are all joined by now, or are those of another such shingle, go. The others
   make units by their largest group, whose documents are cut into blocks by group; a block
   with more than one group of a unit, and each pair of blocks of a unit where not both lie in
   one group and sizes allow a link, is one task: two trees traversed together as before. Work
   grows with the documents that share rare shingles, not with what these chain together.
4. Classes are the components of the links; equal documents hang on their first one.

Skew: a shingle or text that a third of all rows hold is sent once by each chunk; the documents
of a shingle are joined by salts and dealt out in blocks. Nothing is dropped, capped or sampled.

Cases: null or empty texts have no shingles and no links. Rows that share a doc_id are one
document whose links are united. Rows without doc_id are returned without component. Texts of
any length are hashed whole; one text's shingles are one row. Ties need no rule: links do not
depend on an order, and a class is named by its smallest doc_id. An empty table gives an empty
result. Only doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, components, grams, raw, slices, stored, table

SHINGLE = 5
#: Shingles in a chunk and in a bucket, and documents in a chunk.
CHUNK, BUCKET, CHUNK_DOCS = 1_500_000, 2_000_000, 60_000
#: Documents and shingles in a block of signatures.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
FANOUT = 8
#: Salts of the rows of a shingle in a join.
SALTS = 16
PART = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("shared", pa.binary()), ("low", pa.int64()), ("other", pa.int64()), ("chunk", pa.int64())])
SETS_DDL = "doc_id long, n long, first long, digest binary, keys array<long>, shared binary, low long, other long, chunk long"
MULTI = 0xFFFF
#: Odd multiplier that puts shingles in another order.
OTHER = np.uint64(0xA0761D6478BD642F)


def shingles(words: list[bytes], hashes: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(grams(hashes.of(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as planes of their differences' bytes; the upper planes are nearly empty and compress away."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """Documents of one task that send their shingles together."""

    def __init__(self):
        self.rows: list[tuple] = []  # doc, n, digest
        self.sets: list[np.ndarray] = []
        self.owner: dict[bytes, int] = {}  # digest: number of the set
        self.first: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc: int | None, words: list[bytes], hashes: WordHash) -> None:
        if doc is None or not words:
            self.rows.append((doc, len(shingles(words, hashes)), None))
            return
        digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        if digest not in self.owner:
            self.owner[digest] = len(self.sets)
            own = shingles(words, hashes)
            self.sets.append(own)
            self.size += len(own)
        self.first[digest] = min(doc, self.first.get(digest, doc))
        self.rows.append((doc, len(self.sets[self.owner[digest]]), digest))

    def parts(self, number: int, buckets: int) -> Iterator[tuple]:
        """Rows of PART: shingles of each bucket, and what the chunk itself remembers."""
        sizes = [len(x) for x in self.sets]
        all_ = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        order = np.argsort(all_, kind="stable")
        all_, owner = all_[order], owner[order]
        start = np.flatnonzero(np.diff(all_, prepend=~all_[:1])) if len(all_) else np.empty(0, np.int64)
        n = np.diff(start, append=len(all_))
        own = np.where(n > 1, MULTI, owner[start]).astype(np.uint16)
        several = np.repeat(n > 1, n)
        seen = (pack(all_[several]), owner[several].tobytes())
        yield number % buckets, number, 1, pickle.dumps((self.rows, self.owner, self.first, sizes, seen))
        edges = np.searchsorted(bucket_of(all_[start], buckets), np.arange(buckets + 1))
        for b in range(buckets):
            i, j = edges[b], edges[b + 1]
            if i < j:
                some = n[i:j]
                yield b, number, 0, pickle.dumps((pack(all_[start[i:j]]), own[i:j].tobytes(), some[some > 1].astype(np.uint32).tobytes()))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def sent(docs: DataFrame, buckets: int) -> DataFrame:
    """The chunks' parts."""

    def run(batches):
        hashes, chunk, number = WordHash(), Chunk(), TaskContext.get().partitionId() << 32

        def flush():
            for row in chunk.parts(number, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PART, strict=True)], schema=PART)

        for part in slices(batches, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), strict=True):
                chunk.add(doc, (text or b"").lower().split(), hashes)
                if chunk.size >= CHUNK or len(chunk.rows) >= CHUNK_DOCS:
                    yield from flush()
                    chunk, number = Chunk(), number + 1
        if chunk.rows:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, chunk long, kind int, data binary")


def answered(rows: pa.Table) -> pa.Table:
    """A bucket: for each chunk's shingles that occur in two documents or more, in how many."""
    out, parts = [], []
    for b, chunk, kind, data in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
        if kind:
            out.append((b, chunk, 1, data))
        else:
            x, own, several = pickle.loads(data)
            own = np.frombuffer(own, np.uint16)
            n = np.ones(len(own), np.uint32)
            n[own == MULTI] = np.frombuffer(several, np.uint32)
            parts.append((b, chunk, unpack(x), own, n))
    if parts:
        all_ = np.concatenate([p[2] for p in parts])
        n = np.concatenate([p[4] for p in parts])
        order = np.argsort(all_, kind="stable")
        run = all_[order]
        start = np.flatnonzero(np.diff(run, prepend=~run[:1]))
        total = np.add.reduceat(n[order].astype(np.int64), start)
        df = np.empty(len(all_), np.uint32)
        df[order] = np.repeat(total, np.diff(start, append=len(run)))
        at = 0
        for b, chunk, x, own, _ in parts:
            d = df[at : at + len(x)]
            at += len(x)
            keep = d > 1
            if keep.any():
                out.append((b, chunk, 0, pickle.dumps((x[keep].tobytes(), own[keep].tobytes(), d[keep].tobytes()))))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PART, strict=True)], schema=PART)


def least(n: np.ndarray) -> np.ndarray:
    """Common shingles that a set of n needs at least for any link."""
    return -(-4 * n // 5)


def gathered(rows: pa.Table) -> pa.Table:
    """A chunk: rows of SETS. Sets that can link carry their shared shingles, rare ones first, and their prefix."""
    parts, head, chunk = [], None, rows.column(1)[0].as_py()
    for kind, data in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
        if kind:
            head = pickle.loads(data)
        else:
            x, own, d = pickle.loads(data)
            parts.append((np.frombuffer(x, np.uint64), np.frombuffer(own, np.uint16), np.frombuffer(d, np.uint32)))
    docs, owner, first, sizes, (many, many_own) = head
    x, own, d = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate((np.uint64, np.uint16, np.uint32)))
    several = own == MULTI
    if several.any():
        many, many_own = unpack(many), np.frombuffer(many_own, np.uint16)
        known = np.argsort(x[several])
        dm = d[several][known][np.searchsorted(x[several][known], many)]
        x, own, d = (np.concatenate([a[~several], b]) for a, b in ((x, many), (own, many_own), (d, dm)))
    order = np.lexsort((x, d, own))
    x, own = x[order], own[order]
    n = np.array(sizes, np.int64)
    shared = np.bincount(own, minlength=len(n)).astype(np.int64)
    need = least(n)
    begin = np.concatenate([[0], np.cumsum(shared)])
    prefix = n - need + 1 - (n - shared)
    done, out = set(), []
    for doc, size, digest in docs:
        if digest is None:
            out.append((doc, size, doc, None, None, None, None, None, None))
            continue
        i, lead, keys, data, low, other = owner[digest], first[digest], None, None, None, None
        if doc == lead and digest not in done:
            done.add(digest)
            if shared[i] >= need[i]:
                own_x = x[begin[i] : begin[i + 1]]
                keys, data = own_x[: prefix[i]].view(np.int64).tolist(), own_x.tobytes()
                low, other = (int(x.min().view(np.int64)) for x in (own_x, own_x * OTHER))
        out.append((doc, size, lead, digest, keys, data, low, other, chunk))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SETS, strict=True)], schema=SETS)


def sets(docs: DataFrame) -> DataFrame:
    """Stored rows of SETS of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(size / 6 / BUCKET) + 1
    back = sent(docs, buckets).groupBy("bucket").applyInArrow(answered, "bucket int, chunk long, kind int, data binary")
    return stored(back.groupBy("chunk").applyInArrow(gathered, SETS_DDL), "sets")


class Tree:
    """A signature tree: levels from the documents up, each with bitmaps, size ranges and excess."""

    def __init__(self, n: np.ndarray, sets_: list[np.ndarray], bits: int):
        low = np.array([x[0] if len(x) else 0 for x in sets_], np.uint64)
        self.order = np.lexsort((n, low))
        maps = np.zeros((len(n), bits // 8), np.uint8)
        for i, k in enumerate(self.order):
            on = np.zeros(bits, bool)
            on[(sets_[k] & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[i] = np.packbits(on)
        words = maps.view(np.uint64)
        sizes, n = np.array([len(sets_[k]) for k in self.order]), n[self.order]
        self.levels = [(words, n, n, sizes - np.bitwise_count(words).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            words, low_n, high_n, over = self.levels[-1]
            at = np.arange(0, len(low_n), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at), np.maximum.reduceat(over, at)))


def traverse(one: Tree, two: Tree, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of documents (positions in the trees) that may link, with the overlap that their signatures allow."""
    tops = max(len(one.levels), len(two.levels)) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(tops, -1, -1):
        x, y = one.levels[min(level, len(one.levels) - 1)], two.levels[min(level, len(two.levels) - 1)]
        step, keeps = max(1, (8 << 20) // (8 * x[0].shape[1])), []
        for i in range(0, len(a), step):
            p, q = a[i : i + step], b[i : i + step]
            most = np.bitwise_count(x[0][p] & y[0][q]).sum(1, dtype=np.int64) + np.minimum(x[3][p], y[3][q])
            keeps.append(np.where((9 * most >= 4 * (x[1][p] + y[1][q])) & (5 * x[2][p] >= 4 * y[1][q]) & (5 * y[2][q] >= 4 * x[1][p]), most, -1))
        most = np.concatenate(keeps) if keeps else np.empty(0, np.int64)
        ok = most >= 0
        a, b, most = a[ok], b[ok], most[ok]
        if level:
            a, b = children(a, one, level), children(b, two, level)
            n_a, n_b = [len(c) for c in a], [len(c) for c in b]
            pairs = [(np.repeat(c, n), np.tile(d, m)) for c, d, m, n in zip(a, b, n_a, n_b, strict=True)]
            a = np.concatenate([p for p, _ in pairs]) if pairs else np.empty(0, np.int64)
            b = np.concatenate([q for _, q in pairs]) if pairs else np.empty(0, np.int64)
            if same:
                a, b = a[a <= b], b[a <= b]
    return (a[a < b], b[a < b], most[a < b]) if same else (a, b, most)


def children(nodes: np.ndarray, tree: Tree, level: int) -> list[np.ndarray]:
    if level >= len(tree.levels):
        return [np.array([x]) for x in nodes]
    last = len(tree.levels[level - 1][1])
    return [np.arange(FANOUT * x, min(FANOUT * x + FANOUT, last)) for x in nodes]


def joined(docs: np.ndarray, n: np.ndarray, own: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links (numbers of documents) that join what no link before them joins, inside one side or between two; equal labels are joined already."""
    own = [np.sort(x) for x in own]
    bits = 1 << min(max((4 * max(int(np.median([len(x) for x in own])), 1) - 1).bit_length(), 10), 16)
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    up = first[back].tolist()

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    groups = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [Tree(n[g], [own[i] for i in g], bits) for g in groups]
    one, two, same = (trees[0], trees[0], True) if len(trees) == 1 else (trees[0], trees[1], False)
    a, b, most = traverse(one, two, same)
    a, b = groups[0][one.order[a]], groups[-1][two.order[b]]
    order = np.argsort(-most * 2 / (n[a] + n[b]), kind="stable") if len(a) else []
    links = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q and 9 * len(np.intersect1d(own[i], own[j], assume_unique=True)) >= 4 * (n[i] + n[j]):
            up[p] = q
            links.append((i, j))
    return links


NAMES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("label", pa.int64())])


def named(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of NAMES of a block of (item, doc_id, n, shared): the smallest doc_id that links inside the block reach."""
    item, doc, n, shared = zip(*rows, strict=True)
    label = np.array(doc, np.int64)
    found = joined(label, np.array(n, np.int64), [np.frombuffer(x, np.uint64) for x in shared], label, np.zeros(len(rows), np.int8))
    up = {d: d for d in doc}

    def root(d: int) -> int:
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for i, j in found:
        p, q = sorted((root(doc[i]), root(doc[j])))
        up[q] = p
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array([root(d) for d in doc], pa.int64())], schema=NAMES)


def near(rows: DataFrame, order: str) -> DataFrame:
    """rows(item, doc_id, n, shared, and a column to sort by) as (item, doc_id, label): joined inside blocks that are runs of that order."""
    docs, shingles_ = BLOCK, BLOCK_SHINGLES

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("item", "doc_id", "n", "shared")), strict=True):
                if len(held) >= docs or size >= shingles_:
                    yield named(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 8
        if held:
            yield named(held)

    by = [order, "n", "item", "doc_id"]
    return rows.select(*by, "shared").repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by).mapInArrow(run, "item long, doc_id long, label long")


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grouped(some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of near() as (names(item, doc_id, label), links(a, b)); each round after the first takes one document of every group."""
    names = last = stored(near(some, "low"), "near")
    joins = lambda x: x.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
    found, turn = joins(last), 0
    while 0 < last.count() <= 8 * joins(last).count():
        turn += 1
        left = last.where("doc_id = label").select("item", "doc_id")
        last = stored(near(some.join(left, ["item", "doc_id"]), ("low", "other")[turn % 2]), "near")
        found = found.union(joins(last))
        up = last.groupBy(F.col("doc_id").alias("label")).agg(F.min("label").alias("up"))
        names = stored(names.join(up, "label", "left").select("item", "doc_id", F.coalesce("up", "label").alias("label")), "names")
    return names, found


def keyed(some: DataFrame, names: DataFrame) -> DataFrame:
    """(unit, label, n, item, doc_id): documents of the prefix shingles whose documents are of several groups, each set of documents once.

    Shingles with the same largest group make one unit, so that a document comes once to it
    however many of its shingles do.
    """
    marked = stored(some.select("item", "doc_id", "n", "keys").join(names, ["item", "doc_id"]), "marked")
    rows = marked.select("label", "n", "item", "doc_id", F.explode("keys").alias("key"))
    sums = [F.count("*").alias("c"), *(F.bit_xor(F.xxhash64(F.lit(i), "item", "doc_id")).alias(f"x{i}") for i in (1, 2))]
    total = [F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("c", "label")).alias("unit"), F.sum("c").alias("c"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")]
    open_ = rows.groupBy("key", "label").agg(*sums).groupBy("key").agg(*total).where("low <> high").groupBy("unit", "low", "high", "c", "x1", "x2").agg(F.min("key").alias("key"))
    salted = open_.select("key", "unit", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("item", "doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).select("unit", "label", "n", "item", "doc_id").distinct()


DEALT = pa.schema([(c, pa.int64()) for c in ("unit", "label", "n", "item", "doc_id", "block")])


def dealt(rows: DataFrame) -> DataFrame:
    """keyed() rows with a block each: runs of bounded size in order of unit, group (the unit's own first) and set size."""
    docs, shingles_ = BLOCK, BLOCK_SHINGLES

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            own = []
            for n in b.column("n").to_pylist():
                if held >= docs or size >= shingles_:
                    block, held, size = block + 1, 0, 0
                held, size = held + 1, size + n
                own.append(block)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in DEALT.names[:-1]), pa.array(own, pa.int64())], schema=DEALT)

    by = [F.col("unit"), F.col("label") != F.col("unit"), *map(F.col, ("label", "n", "item", "doc_id"))]
    return rows.repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by).mapInArrow(run, "unit long, label long, n long, item long, doc_id long, block long")


def tasks(rows: DataFrame) -> DataFrame:
    """(task, side, label, n, item, doc_id) of dealt() rows: blocks with several groups of a unit, and pairs of a unit's blocks that may link."""
    ranges = stored(rows.groupBy("unit", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("a"), F.max("label").alias("b")), "ranges").withColumn("plain", F.expr("a = b and a = unit"))
    inner = ranges.where("a <> b").select("unit", "block", F.col("block").cast("string").alias("task"), F.lit(0).alias("side"))
    p, q = ranges.where("not plain").alias("p"), ranges.alias("q")
    meet = "p.unit = q.unit and p.block <> q.block and (q.plain or p.block < q.block) and 5 * p.high >= 4 * q.low and 5 * q.high >= 4 * p.low and not (p.a = p.b and q.a = q.b and p.a = q.a)"
    cross = p.join(q, F.expr(meet)).select("p.unit", F.concat_ws(":", "p.block", "q.block").alias("task"), F.explode(F.array(F.struct(F.col("p.block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("q.block").alias("block"), F.lit(1).alias("side")))).alias("x"))
    return rows.join(inner.unionByName(cross.select("unit", "x.block", "task", "x.side")), ["unit", "block"]).select("task", "side", "label", "n", "item", "doc_id").distinct()


def linked(task: pa.Table) -> pa.Table:
    """Links (a, b) of a task's documents."""
    label, n, docs, side = (task.column(c).to_numpy() for c in ("label", "n", "doc_id", "side"))
    found = joined(docs, n, [np.frombuffer(x, np.uint64) for x in task.column("shared").to_pylist()], label, side)
    return pa.table({"a": pa.array([docs[i] for i, _ in found], pa.int64()), "b": pa.array([docs[j] for _, j in found], pa.int64())})


def links(all_sets: DataFrame) -> DataFrame:
    """Links (a, b) between documents with different word sequences, enough of them to join all that are linked."""
    lead = all_sets.where("digest is not null and doc_id = first").groupBy("digest").agg(F.min(F.struct("doc_id", "chunk")).alias("x")).select("digest", "x.*")
    some = all_sets.where("shared is not null").join(lead, ["digest", "doc_id", "chunk"])
    some = stored(some.select(F.xxhash64("digest").alias("item"), "doc_id", "n", "keys", "shared", "low", "other"), "candidates")
    names, found = grouped(some)
    rows = tasks(stored(dealt(keyed(some, names)), "dealt")).join(some.select("item", "doc_id", "shared"), ["item", "doc_id"])
    return found.union(rows.select("task", "side", "label", "n", "doc_id", "shared").groupBy("task").applyInArrow(linked, "a long, b long"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs."""
    all_sets = sets(docs)
    copies = all_sets.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    lead = all_sets.where("digest is not null and doc_id = first").select("digest", "doc_id")
    firsts = lead.join(lead.groupBy("digest").agg(F.min("doc_id").alias("b")), "digest").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    of = components(links(all_sets).union(copies).union(firsts), "classes").withColumnRenamed("node", "doc_id")
    return all_sets.select("doc_id", "n").join(of, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that with the smallest doc_id."""
    gone = classes(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
