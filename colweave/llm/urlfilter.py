"""URL filters by hash prefixes of host-suffix / path-prefix expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (verdict, host, path): the rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Hexadecimal digits of the digest that the join uses.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rules as a DataFrame."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow",
          prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    A rule ``(verdict, host, path)`` fits its host and all subdomains if the URL's path
    starts with the rule's.  The longest rule wins; of equally long ones that with the
    longer host, then block before allow.  Without a fitting rule ``rule`` is null and
    the verdict is ``default``.  A null URL or one without ``://`` has an empty host and
    path, which no rule fits; rules with a null host or path, or an empty host, are
    ignored.  Repeated rows and page_ids stay one row each.

    Each URL is expanded only into the numbers of host labels and the path lengths
    that occur in rules, so a URL has few expressions however long it is.  Expressions
    meet the rules of a short prefix of their SHA-256, all in one row; the full digest
    then picks among them.
    """
    digest = F.sha2(F.concat("host", "path"), 256)
    known = (rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
             .select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
             .withColumn("rule_digest", digest))
    shape = known.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    labels = F.array(*map(F.lit, sorted(shape.labels))).cast("array<int>")
    lengths = F.array(*map(F.lit, sorted(shape.lengths))).cast("array<int>")
    # One row a prefix: the rules whose digests begin with it (a few, as digests spread evenly).
    by_prefix = (known.groupBy("rule_digest", "host", "path")
                 .agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
                 .groupBy(F.substring("rule_digest", 1, prefix_digits).alias("prefix"))
                 .agg(F.collect_list(F.struct(
                     "rule_digest", F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"),
                     F.col("rule_verdict").alias("verdict"), F.concat("host", "path").alias("rule"))).alias("near")))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Equal rows are judged once; their number brings them back.
    distinct = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("rows"))
    parts = distinct.withColumn("parts", F.split("host", r"\."))
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size("parts")),
                        lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    expanded = (parts.select("page_id", "host", "path", "rows", F.explode_outer(expressions).alias("expression"))
                .withColumn("digest", F.sha2("expression", 256))
                .withColumn("prefix", F.substring("digest", 1, prefix_digits)))
    confirmed = F.filter("near", lambda x: x["rule_digest"] == F.col("digest"))
    fitting = expanded.join(by_prefix, "prefix", "left").withColumn("fits", confirmed)
    winner = F.max(F.array_max(F.transform("fits", lambda x: F.struct(
        x["length"].alias("length"), x["host_length"].alias("host_length"), x["verdict"].alias("verdict"), x["rule"].alias("rule")))))
    judged = fitting.groupBy("page_id", "host", "path", "rows").agg(winner.alias("winner"))
    return (judged.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
            .select("page_id", "host", "path", F.col("winner.rule").alias("rule"),
                    F.coalesce("winner.verdict", F.lit(default)).alias("verdict")))
