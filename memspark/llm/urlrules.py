"""URL filters by a sort-merge range join of canonical keys with prefix rules.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's. Canonical keys are the
labels of a host, or of a suffix of it, in reverse order, a ``/`` and the path: ``org.example//en/1``. A rule then is the
interval of keys that its own key begins, and a url asks at one key for each suffix that some rule names. Intervals of
prefixes are nested or apart. Starts and ends of rules and the urls' keys are range-partitioned and
sorted together; a running sum over starts and ends is the height of the stack of open rules, and the top of the stack at a key
is the last rule that opened at that height. Rules open at the first key of a range come to it as starts of their own: a rule
appears once in each range that it spans. All of it is DataFrame functions.

The longest rule (host and path together, then the longer host) of all suffixes wins; urls that none fits get the
default verdict.

Scale: urls are reduced to distinct (host, path) first, so a hot url is one key; a hot host or suffix is cut
by its paths, and equal keys of many hosts by a hash of the host. Only suffixes that rules name are asked, at most as many as the
longest rule host has labels. Rules may be as many as urls: no side is collected or has to be broadcast.

Edge cases: a null url or one without ``://`` has an empty host and path; an empty host fits no rule. Keys are compared by
bytes. Equal rules count once, where their verdicts differ ``block`` holds; rules with a null or empty host, a host with ``/``, ``?`` or ``#``
or a null verdict are left out, a null path counts as empty. No rules, or no rows: no rule fits. Repeated pages are rows of their own; clashing columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, scratch, written

#: The rules of the query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def key_of(reversed_host: Column, path: Column) -> Column:
    return F.concat(reversed_host, F.lit("/"), path).cast("binary")


def clean_rules(rules: DataFrame) -> DataFrame:
    """rule_id, verdict, host, path, reversed host, key: one row per (host, path)."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    rows = rules.select("verdict", host.alias("host"), F.coalesce("path", F.lit("")).alias("path")).where(F.col("host").rlike("^[^/?#]+$") & F.col("verdict").isNotNull())
    rows = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    back = F.array_join(F.reverse(F.split("host", r"\.", -1)), ".")
    return rows.withColumn("back", back).withColumn("key", key_of(back, F.col("path")))


def asked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, key for every suffix of a url's host that some rule names."""
    hosts = rules.select("back").distinct()
    longest = rules.agg(F.max(F.size(F.split("back", r"\.", -1)))).first()[0] or 0
    labels = F.reverse(F.split("host", r"\.", -1))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(longest, 1)))), lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))
    rows = urls.where(F.col("host") != "").withColumn("labels", labels).select("host", "path", F.explode(suffixes).alias("back"))
    return rows.join(hosts, "back", "left_semi").select("host", "path", key_of(F.col("back"), F.col("path")).alias("key"))


#: Order of what happens at one key: rules end (their end lies behind all keys they begin), then rules start, then urls ask.
END, START, ASK = 0, 1, 2


def swept(asks: DataFrame, rules: DataFrame) -> DataFrame:
    """asks (host, path, key) with ``rule`` (verdict, host, path): the innermost rule open at the key, or null."""
    rule = F.struct("verdict", "host", "path")
    none = F.lit(None).cast("struct<verdict:string,host:string,path:string>")
    salt = F.xxhash64("host")
    line = lambda df, key, kind, delta, r, own: df.select(key.alias("key"), F.lit(kind).alias("kind"), salt.alias("salt"), F.lit(delta).alias("delta"), r.alias("rule"), *own)
    empty = [F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")]
    # no UTF-8 text has the byte FF: the end lies behind all keys that begin with the rule's
    ends = line(rules, F.concat("key", F.lit(b"\xff")), END, -1, rule, empty)
    starts = line(rules, F.col("key"), START, 1, rule, empty)
    marks = starts.unionByName(ends).unionByName(line(asks, F.col("key"), ASK, 0, none, ["host", "path"]))
    ranged = written(marks.repartitionByRange("key", "kind", "salt").withColumn("bucket", F.spark_partition_id()), "urlsweep")
    # a rule that opens in one range and closes in a later one is open at the beginning of all between
    spans = ranged.where(F.col("kind") != ASK).groupBy("rule").agg(F.min("bucket").alias("b0"), F.max("bucket").alias("b1")).where("b1 > b0")
    carried = spans.select(F.explode(F.sequence(F.col("b0") + 1, "b1")).alias("bucket"), "rule")
    carried = carried.select(F.lit(0).alias("at"), key_of(F.array_join(F.reverse(F.split("rule.host", r"\.", -1)), "."), F.col("rule.path")).alias("key"), F.lit(START).alias("kind"), F.lit(0).cast("long").alias("salt"), F.lit(1).alias("delta"), "rule", *empty, "bucket")
    both = ranged.withColumn("at", F.lit(1)).unionByName(carried)
    order = ["at", "key", "kind", "salt"]
    height = F.sum("delta").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    levels = both.withColumn("height", height).where(F.col("kind") != END)
    top = F.last("rule", ignorenulls=True).over(Window.partitionBy("bucket", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("top", top).where((F.col("kind") == ASK) & (F.col("height") > 0)).select("host", "path", F.col("top").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path joined), verdict; a row for each page."""
    prepare(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    with scratch(pages.sparkSession):
        rules = written(clean_rules(rules), "urlrules")
        open_at = swept(asked(rows.select("host", "path").distinct(), rules), rules)
        rule = F.col("rule")
        best = open_at.groupBy("host", "path").agg(F.max_by(rule, F.struct(F.length(rule["host"]) + F.length(rule["path"]), F.length(rule["host"]))).alias("rule"))
        best = written(best.select("host", "path", F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict")), "urlverdicts", keep=True)
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, rules_table(pages.sparkSession))


SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT row_number() OVER () AS id, * FROM u),
m AS (SELECT id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (id)
"""
