"""URL filters by a sort-merge range join of reversed-host keys with the rules' prefix intervals.

A host becomes a key of its labels from the last to the first, each closed by a dot, so that a
rule's host and all its subdomains are one interval of keys: from the rule's key to the same
with a byte above all of UTF-8. A rule fits by host and by path, so two sweeps follow each
other: one over the distinct hosts of the rules, which gives every URL the nested rule hosts it
lies in, and one over (rule host, path) keys, where the paths of a rule host's rules are
intervals too. The longest of a URL's rules decides.

A sweep sorts points and the ends of intervals by key. Prefix intervals nest, so the active
ones are a stack: its height is the running count of starts less ends, and the interval at
each level is the last one that started at that level. Spark deals the sorted rows to range
partitions; an interval that spans several of them starts anew in each, at most its depth of
rows for each partition. All is DataFrame functions. URLs are swept once for each different
(host, path), so a host or URL that a third of all rows holds makes no large group: the rows
of one host lie in as many range partitions as their paths take.

Cases: a null URL, or one without `://`, has an empty host and path, which no rule with a host
fits; a rule with an empty or null host fits every host, a null path counts as empty. Of rules
with one host and path, block wins, then the smallest verdict. The longest rule is that with
most characters in host and path together, ties to the longer host. URLs that no rule fits get
the default verdict. Repeated pages get a row each. Empty tables of URLs or rules are allowed.
Only page_id and url are read, so extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"
START, POINT, END = 0, 1, 2


def parts(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    after = F.expr(f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> Column:
    """Labels from the last to the first, each closed by a dot; an empty host has an empty key, a prefix of all."""
    return F.when(F.col(host) == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))).cast("binary")


def above(key: Column | str) -> Column:
    """The end of a prefix's interval: no text in UTF-8 has this byte."""
    return F.concat(key, F.lit(b"\xff"))


def swept(points: DataFrame, rules: DataFrame, whole: bool, tag: str) -> DataFrame:
    """points(key, host, path) with the rule of each active interval: all of the stack if `whole`, else its top. rules(key, rule): different prefixes.

    Points outside all intervals keep one row with a null rule.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no = F.lit(None).cast(rules.schema["rule"].dataType)
    empty = F.lit("")
    rows = points.select("key", F.lit(POINT).alias("kind"), "host", "path", no.alias("rule"), F.lit(None).cast("binary").alias("start"))
    for kind, key in ((START, F.col("key")), (END, above("key"))):
        rows = rows.union(rules.select(key, F.lit(kind), empty, empty, "rule", F.col("key")))
    dealt = stored(rows.repartitionByRange(n, "key", "kind", "host", "path").withColumn("part", F.spark_partition_id()), tag)
    ends = dealt.where(F.col("kind") != POINT)
    spans = ends.groupBy("start").agg(F.first("rule").alias("rule"), F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    again = spans.select(F.col("start").alias("key"), F.lit(START).alias("kind"), empty.alias("host"), empty.alias("path"), "rule", "start", F.explode(F.expr("sequence(a + 1, b)")).alias("part"))
    order = [F.col("key"), F.col("kind")]
    height = F.sum(F.expr(f"case kind when {START} then 1 when {END} then -1 else 0 end")).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    stack = dealt.unionByName(again).withColumn("height", height).where(F.col("kind") != END)
    levels = F.when((F.col("kind") == POINT) & F.lit(whole) & (F.col("height") > 1), F.sequence(F.lit(1).cast("long"), "height")).otherwise(F.array("height"))
    stack = stack.withColumn("level", F.explode(levels))
    top = F.last("rule", ignorenulls=True).over(Window.partitionBy("part", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return stack.withColumn("rule", F.when(F.col("level") > 0, top)).where(F.col("kind") == POINT).select("host", "path", "rule")


def matched(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of each different pair(host, path): columns host, path, rule, verdict, null where none fits."""
    rules = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path")), F.col("verdict").cast("string"))
    rules = rules.groupBy("host", "path").agg(F.coalesce(F.max(F.when(F.col("verdict") == "block", "block")), F.min("verdict")).alias("verdict"))
    keyed = rules.select(host_key("host").alias("hosts"), F.struct("host", "path", "verdict").alias("rule"))
    hosts = keyed.select(F.col("hosts").alias("key"), F.col("hosts").alias("rule")).distinct()
    inside = swept(pairs.select(host_key("host").alias("key"), "host", "path"), hosts, True, "url-hosts")
    both = lambda hosts, path: F.concat(hosts, F.lit(b"\x00"), path.cast("binary"))  # noqa: E731  no host key holds or continues with this byte below a rule's own
    points = inside.where("rule is not null").select(both(F.col("rule"), F.col("path")).alias("key"), "host", "path")
    found = swept(points, keyed.select(both(F.col("hosts"), F.col("rule.path")).alias("key"), "rule"), False, "url-paths").where("rule is not null")
    size = F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))
    return found.groupBy("host", "path").agg(F.max_by("rule", size).alias("rule")).select("host", "path", F.concat("rule.host", "rule.path").alias("rule"), "rule.verdict")


def filtered(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url)."""
    host, path = parts("url")
    rows = pages.select("page_id", F.col("url").cast("string")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    found = matched(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
