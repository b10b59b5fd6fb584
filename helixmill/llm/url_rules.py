"""URL filters: rules on a host and a path prefix, applied by a sorted sweep.

Hosts are turned round label by label (`www.example.com` is `com.example.www.`), so that a rule for a host and all its
subdomains is the interval of keys that start with the rule's key. Urls and rule intervals are dealt to ranges of keys;
in each range the rows come in key order and a stack holds the rules whose intervals are open, nested ones on top.

The ranges' borders come from a sample of (key, row hash) and only decide where a row is worked on, never its result.
The row hash is part of the border, so a host with a third of all rows spreads over many ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import table

#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Above every character of a host key.
TOP = chr(0x10FFFF)


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Labels in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class PathRules:
    """The path prefixes of one host, sorted, each with the next shorter prefix that it extends."""

    def __init__(self, host: str, rules: Iterable[tuple[str, str]]):
        own = dict(sorted(rules, key=lambda x: (x[0], x[1] == "allow")))  # of equal prefixes the last is kept
        self.host, self.paths, self.verdicts, self.parent = host, list(own), list(own.values()), []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.parent.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parent[i]
        return i


def best_rule(stack: list[tuple[str, PathRules]], path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fitting rule on the stack; the longer host on ties."""
    best, length = None, -1
    for _, at in reversed(stack):
        if (i := at.longest(path)) >= 0 and len(at.host) + len(at.paths[i]) > length:
            best, length = (at.host + at.paths[i], at.verdicts[i]), len(at.host) + len(at.paths[i])
    return best


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and key, rules before urls; the url rows' `row` with rule and verdict."""
    bucket, stack = None, []
    for batch in batches:
        urls, found = [], []
        for i, (b, key, host, path, rules) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "host", "path", "rules")))):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rules is None:
                urls.append(i)
                found.append(best_rule(stack, path) or (None, None))
            else:
                stack.append((key, PathRules(host, [(x["path"], x["verdict"]) for x in rules])))
        kept = batch.take(pa.array(urls, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("row"), kept.column("host"), kept.column("path"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["row", "host", "path", "rule", "rule_verdict"])


def sampled_borders(keyed: DataFrame, n: int, sample: int) -> list[tuple[str, int]]:
    """At most n - 1 borders (key, salt) between ranges of about as many rows, from about `sample` rows of any table."""
    total = keyed.count()
    share = min(1.0, sample / max(total, 1))
    got = sorted((r.key, r.salt) for r in keyed.select("key", "salt").where(F.pmod(F.xxhash64("salt", "key"), F.lit(1_000_003)) <= F.lit(int(share * 1_000_003))).limit(4 * sample).collect())
    return sorted({got[i * len(got) // n] for i in range(1, n)}) if got else []


def apply_url_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", default: str = "allow", ranges: int | None = None, sample: int = 20_000) -> DataFrame:
    """Adds host, path, rule (host followed by path prefix, null if none fits) and verdict to all columns of `pages`.

    A rule fits its host and every subdomain, if the path starts with the rule's path; the longest (host and path
    together) wins, the longer host on ties; of two equal rules allow wins. Without a rule the verdict is `default`.
    Null, empty or malformed urls have an empty host and path, which no rule with a path of `/` fits. Columns of these
    four names are replaced. Repeated rows each get a result; an empty table gives an empty result. `rules`: a list or
    a DataFrame (host, path, verdict); a range holds the rules that overlap it only.
    """
    spark: SparkSession = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.drop("host", "path", "rule", "verdict")
    keyed = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.struct(*(pages[c] for c in pages.columns)).alias("row"))
    keyed = keyed.withColumns({"key": host_key(F.col("host")), "salt": F.xxhash64("row")})
    cuts = sampled_borders(keyed, ranges, sample)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    nodes = rules.groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules")).withColumn("key", host_key(F.col("host")))

    @F.pandas_udf("int")
    def bucket(key, salt):
        return key.combine(salt, lambda k, s: bisect_right(cuts, (k, s)))

    @F.pandas_udf("array<int>")
    def buckets(key):
        return key.map(lambda k: list(range(bisect_left(cuts, (k, -(2**63))), bisect_right(cuts, (k + TOP, 2**63 - 1)) + 1)))

    left = keyed.select(bucket("key", "salt").alias("bucket"), "key", "host", "path", F.lit(None).cast(nodes.schema["rules"].dataType).alias("rules"), "row")
    right = nodes.select(F.explode(buckets("key")).alias("bucket"), "key", "host", F.lit("").alias("path"), "rules", F.lit(None).cast(keyed.schema["row"].dataType).alias("row"))
    dealt = left.unionByName(right).repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", F.col("rules").isNull())
    row = keyed.schema["row"].dataType.simpleString()
    judged = dealt.mapInArrow(sweep, f"row {row}, host string, path string, rule string, rule_verdict string")
    return judged.select("row.*", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_url_rules(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
