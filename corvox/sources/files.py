"""Sources and sinks: file catalogues, JSON documents, Parquet episodes, reports."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvox.functions.columns import png_size, suffix

INDEX = "episode_index long, case_id string, length long, tasks array<string>"
EPISODE = "episode_index long, frame_index long, action array<float>"
GRAPH = "root string, method string, nodes array<struct<id string, point_mm array<double>, radius_mm double, branch_id string, generation long, distance_mm double, accessible boolean>>, edges array<struct<source string, target string, length_mm double, branch_id string, generation long, accessible boolean>>"
PATHS = "paths array<struct<path_id string, frames array<struct<frame_index long, time_s double, position array<double>, quaternion array<double>, phase string>>>>"
CASE = "case_id string, quality struct<mesh struct<vertices long, faces long, spacing array<double>, centerline struct<nodes long, length_mm double, branches long>>, checks map<string,boolean>, airway struct<voxels long>, path struct<length_mm double, frames long>>, artifacts struct<ct_orientation string>"


def catalogue(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """Files below root with one of the suffixes: path and length. Bodies are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(suffix(F.col("path")).isin(suffixes)).orderBy(F.split("path", "/"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; unreadable lines keep their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def flattened_cases(cases: DataFrame) -> DataFrame:
    """Scalars of nested case descriptions (CASE); missing objects give null, missing spacing the default."""
    q, m = F.col("quality"), F.col("quality.mesh")
    return cases.select(
        "case_id", m["vertices"].alias("vertices"), m["faces"].alias("faces"), m["centerline"]["nodes"].alias("nodes"), m["centerline"]["length_mm"].alias("centerline_mm"), m["centerline"]["branches"].alias("branches"),
        F.coalesce(m["spacing"], F.array(F.lit(0.747), F.lit(0.747), F.lit(1.2218))).alias("spacing"), q["airway"]["voxels"].alias("voxels"), q["path"]["length_mm"].alias("path_mm"), q["path"]["frames"].alias("frames"),
        F.coalesce((F.size(F.map_values(q["checks"])) > 0) & F.forall(F.map_values(q["checks"]), lambda x: x), F.lit(False)).alias("checks_all"), F.col("artifacts.ct_orientation").alias("orientation"),
    )


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episode, frame and action alone; images in the same files are not read."""
    return spark.read.parquet(path).select("episode_index", "frame_index", "action")


def graph_nodes(graphs: DataFrame) -> DataFrame:
    """graphs(case_id, nodes, ...): a row per node with its place in the list, after first_node others where a case has several documents."""
    n = graphs.select("case_id", F.col("first_node") if "first_node" in graphs.columns else F.lit(0).alias("first_node"), F.posexplode("nodes").alias("node_ord", "n"))
    return n.select("case_id", (F.col("first_node") + F.col("node_ord")).alias("node_ord"), F.col("n.id").alias("id"), *(F.col("n.point_mm")[i].alias(a) for i, a in enumerate("xyz")), F.col("n.radius_mm").alias("radius"), "n.branch_id", "n.generation", F.col("n.distance_mm").alias("dist"), "n.accessible")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """The same of edges and first_edge."""
    e = graphs.select("case_id", F.col("first_edge") if "first_edge" in graphs.columns else F.lit(0).alias("first_edge"), F.posexplode("edges").alias("edge_ord", "e"))
    return e.select("case_id", (F.col("first_edge") + F.col("edge_ord")).alias("edge_ord"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.length_mm").alias("length"), "e.branch_id", "e.generation", "e.accessible")


def path_frames(documents: DataFrame, path_id: str | None = None) -> DataFrame:
    """documents(case_id, paths): a row per frame of the named path, or of the first; an error where it is absent."""
    named = F.filter("paths", lambda p: p["path_id"] == path_id) if path_id is not None else F.slice("paths", 1, 1)
    one = F.when(F.size(named) > 0, F.element_at(named, 1)).otherwise(F.raise_error(F.lit("no such path")).cast(dict(documents.dtypes)["paths"][6:-1]))
    return documents.select("case_id", one.alias("p")).select("case_id", "p.path_id", F.explode("p.frames").alias("f")).select("case_id", "path_id", "f.*")


def metadata(m: Column, key: str) -> Column:
    """A map's value by exact key, else by the key in any case."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.try_element_at(F.map_values(F.map_filter(m, lambda k, v: F.lower(k) == key.lower())), F.lit(1)))


def write_radius_profile(nodes: DataFrame, path: str, buckets: int = 64) -> None:
    """Nodes as Parquet in hash buckets of their cases, so that many cases do not make many small files."""
    profile(nodes, buckets).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def profile(nodes: DataFrame, buckets: int) -> DataFrame:
    keep = [c for c in ("case_id", "id", "branch_id", "dist", "radius", "generation", "accessible", "x", "y", "z") if c in nodes.columns]
    return nodes.select(*keep, F.pmod(F.hash("case_id"), F.lit(buckets)).alias("bucket"))


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON text with keys in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    report_json(rows).orderBy("value").write.text(path)


def report_lines(totals: DataFrame, formats: dict[str, int]) -> DataFrame:
    """Columns of a one-row report as name and formatted value, with separators and the given decimals."""
    cells = [F.struct(F.lit(n).alias("name"), F.format_number(F.col(n).cast("double"), d).alias("value")) for n, d in formats.items()]
    return totals.select(F.explode(F.array(*cells)).alias("x")).select("x.name", "x.value")


#: Bytes of one read of an image's header.
HEADER = 4096
#: JPEG markers of frames that carry a size, and those without a body.
FRAMES, BARE = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0xD8, 0xD9}


def image_size(read: Callable[[int, int], bytes]) -> tuple[int | None, int | None]:
    """Width and height of a PNG or JPEG behind read(offset, length), from as few reads as its segments need; (None, None) for others and cut ones."""
    number = lambda b: int.from_bytes(b, "big")
    head = read(0, 32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return number(head[16:20]), number(head[20:24])
    if head[:2] != b"\xff\xd8":
        return None, None
    at = 2
    while True:
        mark = read(at, 9)
        if len(mark) < 2:
            return None, None
        if mark[0] != 0xFF or mark[1] == 0xFF or mark[1] in BARE:
            at += 2 if mark[0] == 0xFF and mark[1] in BARE else 1
            continue
        length = number(mark[2:4])
        if len(mark) < 4 or length < 2:
            return None, None
        if mark[1] in FRAMES:
            return (number(mark[7:9]), number(mark[5:7])) if len(mark) == 9 else (None, None)
        at += 2 + length


class Ranges:
    """Reads of a file by ranges, each of HEADER bytes, the last one kept; `taken` counts the bytes."""

    def __init__(self, handle):
        self.handle, self.size, self.start, self.data, self.taken = handle, handle.size(), 0, b"", 0

    def __call__(self, offset: int, length: int) -> bytes:
        if not self.start <= offset or offset + length > self.start + len(self.data):
            wanted = max(0, min(max(length, HEADER), self.size - offset))
            self.start, self.data = offset, self.handle.read_at(wanted, offset) if wanted else b""
            self.taken += len(self.data)
        return self.data[offset - self.start : offset - self.start + length]


def image_headers(files: DataFrame) -> DataFrame:
    """files(path): width, height and the bytes that were read to find them. Tasks open the files and read ranges of their headers, never whole bodies; a file that can't be opened has nulls."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
                    with system.open_input_file(place) as handle:
                        read = Ranges(handle)
                        rows.append((path, *image_size(read), read.taken))
                except (OSError, TypeError):
                    rows.append((path, None, None, None))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["path", "width", "height", "bytes_read"])

    return files.select("path").mapInArrow(run, "path string, width int, height int, bytes_read long")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Width and height of image bytes."""
    found = [(None, None) if x is None else image_size(lambda o, n, x=bytes(x): x[o : o + n]) for x in content]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")


def image_sizes(files: DataFrame) -> DataFrame:
    """files(path, content): width and height, null for what is neither PNG nor JPEG. For files in a store image_headers() reads less."""
    w, h = png_size(F.col("content"))
    rest = jpeg_size("content")
    return files.select("path", F.coalesce(w, rest["width"]).alias("width"), F.coalesce(h, rest["height"]).alias("height"))
