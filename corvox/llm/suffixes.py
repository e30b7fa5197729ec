"""Removal of repeated substrings by sparse suffix sorting.

A byte is removed if a LENGTH-byte string that also starts elsewhere covers it. Of every such
window the k-gram with the smallest hash (the last of equals) is its anchor, so equal windows
have their anchors at the same place in them and only suffixes at anchors need sorting.

1. Each document's windows are grouped into runs with one anchor; a run is one row with the
   hash of the anchor's k-gram and that of the whole run. k-grams that occur once leave here.
2. A run that another equals is repeated as a whole; this is a count with map-side combine.
3. What is left are runs at the edges of repeats. Runs with one k-gram are sorted by the text
   right of the anchor, and by that left of it read backwards: multikey quicksort on 8-byte
   words to a shallow depth, then a blind trie for each group with a long common prefix. The
   common prefixes of two runs to both sides tell which of their windows are equal.
4. Runs that share a k-gram with more than GROUP others, which no task should hold, are split by
   more of their context: windows are cut into steps by distance from the anchor, steps with the
   same core form smaller groups, and these are sorted as above or split again.
5. Each document loses the bytes that its repeated windows cover.

Cases: null text is empty and loses nothing. Texts shorter than LENGTH lose nothing. Rows that
repeat a document are copies like any others. Rows that share a doc_id are told apart by text.
Texts of any length are cut into segments for hashing only. Ties of anchors go to the last
place. An empty table gives an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvox.sources.scratch import observed

from .common import arrow_schema, mix, raw, slices, stored, table

LENGTH, GRAMS = 400, 200
SHALLOW = 16
#: Most runs that a task sorts together; more are split.
GROUP = 512
SEGMENT = 8 << 20
PLACE = np.uint64((1 << 24) - 1)
RUNS = "id long, th long, kh long, sh long, a int, s int, e int"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
P = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and its inverse for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (P, INVERSE):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(step)
                done, step = done + more, step * step % (1 << 64)
            _powers.append(out)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any substring of at least 8 bytes."""

    def __init__(self, data: bytes):
        n = len(data)
        words = np.ndarray((n,), "<u8", data + b"\0" * 8, 0, (1,)).astype(np.uint64)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size - 7] - self.sums[start]) * self.down[start] + np.uint64(1) * np.asarray(size, np.uint64))


def runs(data: bytes, starts: np.ndarray, length: int, grams: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in concatenated texts: number of text, k-gram hash, run hash, anchor, first and last window (from the text's start). starts has the end as its last."""
    n, k = len(data), length - grams + 1
    empty = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    roll = Rolling(data)
    at = np.arange(n - k + 1)
    key = (roll.of(at, k) & ~PLACE) | (PLACE - at.astype(np.uint64))
    low, have = key, 1
    while have * 2 <= grams:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if have < grams:
        low = np.minimum(low[: len(low) - (grams - have)], low[grams - have :])
    anchor = (PLACE - (low & PLACE)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(anchor)]
    ok = np.flatnonzero(np.arange(len(anchor)) + length <= starts[doc + 1])
    if not len(ok):
        return empty
    anchor, doc = anchor[ok], doc[ok]
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(first[1:], len(ok)) - 1
    s, e, a, d = ok[first], ok[last], anchor[first], doc[first]
    sh = roll.of(s, e + length - s) + mix((a - s).astype(np.uint64)) * np.uint64(P)
    base = starts[d]
    return d, roll.of(a, k), sh, a - base, s - base, e - base


def run_rows(docs: DataFrame, length: int, grams: int) -> DataFrame:
    """Rows of RUNS of docs(id, th, text)."""
    schema = arrow_schema(RUNS)

    def rows(batches):
        for part in slices(batches, "text", 2 << 20):
            texts = [t or b"" for t in raw(part.column("text"))]
            ids, ths = part.column("id").to_numpy(), part.column("th").to_numpy()
            whole = [i for i, t in enumerate(texts) if len(t) <= SEGMENT]
            starts = np.cumsum([0] + [len(texts[i]) for i in whole])
            jobs = [(b"".join(texts[i] for i in whole), starts, np.array(whole, np.int64), 0)]
            for i, t in enumerate(texts):
                for x in range(0, len(t) - length + 1, SEGMENT) if len(t) > SEGMENT else ():
                    cut = t[x : x + SEGMENT + length - 1]
                    jobs.append((cut, np.array([0, len(cut)]), np.array([i]), x))
            for data, starts, names, off in jobs:
                d, kh, sh, a, s, e = runs(data, starts, length, grams)
                own = names[d] if len(d) else d
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64) if f.type == pa.int64() else (x + off).astype(np.int32)) for x, f in zip((ids[own], ths[own], kh.view(np.int64), sh.view(np.int64), a, s, e), schema, strict=True)], schema=schema)

    return docs.mapInArrow(rows, RUNS)


def prefix(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branching bytes alone; one comparison with a leaf places each string."""

    def __init__(self):
        self.root: list | None = None  # [depth, {byte: node}] or ["leaf", [numbers]]

    def insert(self, strings: list[bytes], i: int) -> None:
        text = strings[i]
        if self.root is None:
            self.root = ["leaf", [i]]
            return
        node, path = self.root, []
        while node[0] != "leaf":
            path.append(node)
            depth, kids = node
            b = text[depth] if depth < len(text) else -1
            node = kids[b] if b in kids else next(iter(kids.values()))
        other = strings[node[1][0]]
        common = prefix(text, other)
        if common == len(text) == len(other):
            node[1].append(i)
            return
        mine = text[common] if common < len(text) else -1
        above, below = None, self.root
        for step in path:
            if step[0] >= common:
                break
            above, below = step, step[1].get(text[step[0]] if step[0] < len(text) else -1)
        if below is not None and below[0] == common:
            below[1][mine] = ["leaf", [i]]
            return
        new = [common, {mine: ["leaf", [i]], (other[common] if common < len(other) else -1): below}]
        if above is None:
            self.root = new
        else:
            above[1][text[above[0]] if above[0] < len(text) else -1] = new

    def ordered(self, strings: list[bytes]) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; 0 for the first."""
        stack, common = [(self.root, 0)], 0
        while stack:
            node, common = stack.pop()
            if node[0] == "leaf":
                for n, i in enumerate(node[1]):
                    yield i, common if n == 0 else len(strings[i])
            else:
                kids = sorted(node[1].items())
                stack += [(kid, node[0]) for _, kid in reversed(kids[1:])]
                stack.append((kids[0][1], common))


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Suffix order of the strings, and the common prefix of each with the one before it.

    Multikey quicksort on 8-byte words down to `shallow` bytes; groups equal so far go to a blind trie.
    """
    heads = np.frombuffer(b"".join(x[:shallow].ljust(shallow, b"\0") for x in strings), ">u8").reshape(len(strings), -1)
    order: list[int] = []
    commons: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) > 1 and depth < heads.shape[1]:
            word = heads[group, depth]
            pivot = word[len(word) // 2]
            more, less = group[word > pivot], group[word < pivot]
            if len(more):
                stack.append((more, depth))
            stack.append((group[word == pivot], depth + 1))
            if len(less):
                stack.append((less, depth))
            continue
        trie = BlindTrie()
        for i in group.tolist():
            trie.insert(strings, i)
        for i, common in trie.ordered(strings):
            if i is not None and order and not common:
                common = prefix(strings[order[-1]], strings[i])
            order.append(i)
            commons.append(common)
    commons[0] = 0
    return order, commons


def reach(strings: list[bytes]) -> np.ndarray:
    """Common prefix of every two of a group's strings, as a matrix."""
    order, commons = deep_shallow(strings)
    n = len(order)
    out = np.zeros((n, n), np.int32)
    along = np.array(commons)
    for x in range(n - 1):
        row = np.minimum.accumulate(along[x + 1 :])
        out[order[x], order[x + 1 :]] = row
    return np.maximum(out, out.T)


def equal_windows(members: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each run (text, anchor's place in it, last window's place) the ranges of windows, by distance left of the anchor, that another run has too."""
    right = reach([text[a:] for text, a, _ in members])
    left = reach([text[:a][::-1] for text, a, _ in members])
    out = []
    for i, (_, a, e) in enumerate(members):
        low, high = np.maximum(length - right[i], max(a - e, 0)), np.minimum(left[i], a)
        ok = high >= low
        ok[i] = False
        if not ok.any():
            out.append([])
            continue
        mark = np.zeros(a + 2, np.int32)
        np.add.at(mark, low[ok], 1)
        np.add.at(mark, high[ok] + 1, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark[: a + 1]) > 0).astype(np.int8), [0]])))
        out.append([(int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


FOUND = "id long, th long, i0 int, i1 int"


def edges(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows (FOUND) of edge runs, rows(kh, n, id, th, a, s, e, text), by suffix sorting. Rows with n = 1 are answered, all are compared."""
    schema, n = arrow_schema(FOUND), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answer(group: list[tuple]) -> Iterator[tuple]:
        if len(group) > 1:
            for (_, n, id_, th, a, _, _, _), ranges in zip(group, equal_windows([(t, a - s, e - s) for _, _, _, _, a, s, e, t in group], length), strict=True):
                if n == 1:
                    for low, high in ranges:
                        yield id_, th, a - high, a - low

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += answer(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)
        out = list(answer(group))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)

    return rows.select("kh", "n", "id", "th", "a", "s", "e", "text").repartition(n, "kh").sortWithinPartitions("kh").mapInArrow(run, FOUND)


PIECES = "kh long, c int, lo int, hi int, core long, whole long, id long, th long, a int, s int, n int"
#: Distances of windows from their anchor that are looked at together where a group is too large for a task, wide ones first.
WIDTHS = (64, 16, 4, 1)
#: A key of more rows than FEW and than this part of all rows is dealt in joins, SALTS pieces for each such part: pieces fall on tasks by hash, so many small ones are dealt more evenly than few large ones.
PART, FEW, SALTS = 4096, 512, 16


def met(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows with their row of keys (unique in `on`; `size`: no fewer than the rows that it meets, `total`: of all rows). Keys with more than a PART of the rows, hence few, are sent to all tasks, which deal their rows evenly; the others go to one task each."""
    parts, one = F.ceil(F.col(size) / F.lit(max(total // PART, FEW))).cast("long"), F.lit(1).cast("long")
    pieces_ = F.when(parts > 1, parts * SALTS).otherwise(one)
    large = F.broadcast(keys.where(parts > 1).select(*on, pieces_.alias("pieces")))
    left = rows.join(large, on, "left").withColumn("salt", F.pmod(F.xxhash64("id", "th", "s"), F.coalesce("pieces", one))).drop("pieces")
    right = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces_ - 1)))
    return left.join(right, [*on, "salt"], how).drop("salt")


def pieces(rows: DataFrame, width: int, before: int, length: int) -> DataFrame:
    """Rows of PIECES: the windows of a run in steps of `width` distances. core: hash of the bytes that all windows of a step hold; whole: of those that any holds, if the run has the full step. want: steps of width `before` that are open, null for all."""
    schema = arrow_schema(PIECES)

    def split(batches):
        for part in slices(batches, "text", 1 << 19):
            out = []
            for kh, n, id_, th, a, s, e, text, want in zip(*(c.to_pylist() for c in part.columns), strict=True):
                near, far = a - e, a - s
                spans = [(x["c"] * before, x["c"] * before + before - 1, x["n"]) for x in want] if want is not None else [(near, far, min(n, 2))]
                steps = [(d // width, k) for low, high, k in spans for d in range(max(low, near) // width * width, min(high, far) + 1, width)]
                if not steps:
                    continue
                roll, c = Rolling(text), np.array([x for x, _ in steps])
                first, last = c * width, c * width + width - 1
                core = roll.of(far - first, length - width + 1).view(np.int64).tolist()
                full = (first >= near) & (last <= far)
                whole = np.zeros(len(c), np.int64)
                whole[full] = roll.of(far - last[full], length + width - 1).view(np.int64)
                out += [(kh, x, max(int(p), near), min(int(q), far), g, int(w) if f else None, id_, th, a, s, k) for (x, k), p, q, g, w, f in zip(steps, first, last, core, whole, full, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    return rows.select("kh", "n", "id", "th", "a", "s", "e", "text", "want").mapInArrow(split, PIECES)


def hot_windows(rows: DataFrame, length: int, grams: int, group: int) -> DataFrame:
    """As edges(), for k-grams with more than `group` runs, which are split by more context until each part is sorted in a task.

    The windows of a run are cut into steps of `width` distances from the anchor. Equal windows
    of one step share its core, so runs are grouped by core anew. Equal whole steps are
    repeated and go on as one; groups of at most `group` different steps are sorted; larger
    ones are cut into smaller steps. A step of one window is its own core, so all end.
    """
    run, widths = ["kh", "id", "th", "a", "s"], [w for w in WIDTHS if w < grams or w == 1]
    open_, out, before = rows.withColumn("want", F.lit(None).cast("array<struct<c:int,n:int>>")), None, 1
    for width in widths:
        each, total = observed(pieces(open_, width, before, length), "pieces", total=F.count(F.lit(1)))
        whole = each.where("whole is not null").groupBy("kh", "c", "core", "whole").agg(F.sum("n").cast("int").alias("n"), F.min(F.struct("id", "th", "a", "s", "lo", "hi")).alias("x"))
        whole = stored(whole, "whole")
        part = met(each.where("n = 1"), whole.where("n > 1").select("kh", "c", "whole", "n"), ["kh", "c", "whole"], "n", total, "left_semi").select("id", "th", (F.col("a") - F.col("hi")).alias("i0"), (F.col("a") - F.col("lo")).alias("i1"))
        out = part if out is None else out.union(part)
        if width == widths[-1]:
            return out
        kinds = whole.select("kh", "c", "core", "n", "x.*").union(each.where("whole is null").select("kh", "c", "core", "n", "id", "th", "a", "s", "lo", "hi"))
        several = stored(kinds.groupBy("kh", "c", "core").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("kh", "c", "core", "m"), "several")
        left = stored(met(kinds, several, ["kh", "c", "core"], "m", total), "kinds")
        few = left.where(f"m <= {group}").groupBy(*run).agg(F.collect_list(F.struct(F.xxhash64("kh", "c", "core").alias("kh"), F.least("n", F.lit(2)).cast("long").alias("n"), "a", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo")).alias("e"))).alias("want"))  # the steps of one run
        out = out.union(edges(steps(rows.select(*run, "text").join(few, run), length), length))
        want = left.where(f"m > {group}").groupBy(*run).agg(F.collect_list(F.struct("c", F.least("n", F.lit(2)).alias("n"))).alias("want"))
        open_, before = rows.join(stored(want, "open"), run), width


def steps(rows: DataFrame, length: int) -> DataFrame:
    """Runs of their own, with their bytes, of the wanted steps of rows(kh, id, th, a, s, text, want)."""
    ddl = "kh long, n long, id long, th long, a int, s int, e int, text binary"
    schema = arrow_schema(ddl)

    def cut(batches):
        for part in slices(batches, "text", 1 << 20):
            out = []
            for id_, th, s, text, want in zip(*(part.column(c).to_pylist() for c in ("id", "th", "s", "text", "want")), strict=True):
                out += [(w["kh"], w["n"], id_, th, w["a"], w["s"], w["e"], text[w["s"] - s : w["e"] - s + length]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    return rows.mapInArrow(cut, ddl)


def repeats(docs: DataFrame, length: int = LENGTH, grams: int = GRAMS, group: int = GROUP) -> DataFrame:
    """Ranges of repeated windows (FOUND) of docs(id, th, text)."""
    all_, total = observed(run_rows(docs, length, grams), "runs", total=F.count(F.lit(1)))
    often = stored(all_.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1"), "often")
    some = stored(met(all_, often, ["kh"], "n", total).drop("n"), "repeated")
    kinds = stored(some.groupBy("kh", "sh").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "a", "s", "e")).alias("x")), "kinds")
    whole = met(some, kinds.where("n > 1").select("kh", "sh", "n"), ["kh", "sh"], "n", total, "left_semi").select("id", "th", F.col("s").alias("i0"), F.col("e").alias("i1"))
    several = stored(kinds.groupBy("kh").agg(F.count("*").alias("m"), F.min("n").alias("low")).where("m > 1 and low = 1").select("kh", "m"), "several")
    texts = cut_texts(docs, met(kinds.select("kh", "n", "x.*"), several, ["kh"], "m", total), length)
    small, large = texts.where(f"m <= {group}"), texts.where(f"m > {group}")
    return whole.union(edges(small, length)).union(hot_windows(large, length, grams, group))


def cut_texts(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """rows(kh, n, m, id, th, a, s, e) with the bytes of their windows, from docs(id, th, text)."""
    wanted = rows.groupBy("id", "th").agg(F.collect_list(F.struct("kh", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), "a", "s", "e")).alias("want"))  # one document's own runs
    ddl = "kh long, n long, m long, id long, th long, a int, s int, e int, text binary"
    schema = arrow_schema(ddl)

    def cut(batches):
        for part in slices(batches, "text", 1 << 20):
            out = []
            for id_, th, text, want in zip(part.column("id").to_pylist(), part.column("th").to_pylist(), raw(part.column("text")), part.column("want").to_pylist(), strict=True):
                out += [(w["kh"], w["n"], w["m"], id_, th, w["a"], w["s"], w["e"], text[w["s"] : w["e"] + length]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


    return stored(docs.join(wanted, ["id", "th"]).select("id", "th", "text", "want").mapInArrow(cut, ddl).dropDuplicates(["kh", "id", "th", "a", "s"]), "texts")


def pruned_text(text: bytes, ranges: list[int], length: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, and the kept stretches, given windows as start * 2^32 + last."""
    cover: list[list[int]] = []
    for x in ranges:
        a, b = x >> 32, (x & 0xFFFFFFFF) + length
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(b, cover[-1][1])
        else:
            cover.append([a, b])
    keep, at = [], 0
    for a, b in cover:
        keep.append((at, a))
        at = b
    return sum(b - a for a, b in cover), len(cover), [*keep, (at, len(text))]


def marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(-1).cast("long")), "th": F.xxhash64("text")})


def pruned(docs: DataFrame, length: int = LENGTH, grams: int = GRAMS, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept binary), one per row of docs(doc_id, text)."""
    rows = marked(docs)
    found = repeats(rows.where(F.octet_length("text") >= length).select("id", "th", "text"), length, grams, group)
    ranges = found.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.col("i0").cast("long") * (1 << 32) + F.col("i1"))).alias("ranges"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    schema = arrow_schema(ddl)

    def prune(batches):
        for part in slices(batches, "text"):
            out = []
            for doc, text, windows in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), part.column("ranges").to_pylist(), strict=True):
                removed, spans, keep = pruned_text(text, windows or [], length)
                out.append((doc, len(text), removed, spans, b"".join(text[a:b] for a, b in keep)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.join(ranges, ["id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(prune, ddl)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the text that is kept (characters cut in part are replaced)."""
    return pruned(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
