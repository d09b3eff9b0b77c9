"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every URL is expanded into the expressions that a rule could be written as: its host and all
its parent domains, each with the path's prefixes (of the lengths that rules have). The
expressions meet the rules in an equi-join on the first bytes of their SHA-256 digests; the full
digests are then compared and the longest rule wins. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule table is broadcast up to so many rows, else the join shuffles.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8

#: (host, path, verdict)
DEFAULT_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, *FOLD), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    default: str = "allow",
) -> DataFrame:
    """(<id_col>, host, path, rule, verdict), one row per input row.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the
    path starts with the rule's path. The longest rule (host and path together) wins; of equally
    long ones block before allow, then the smallest; rule is its text, null if none fits, and
    verdict then `default`. A null URL or one without :// has an empty host and path and no
    rule. Repeated rows each get their row. Rules with a null or empty host fit nothing; hosts
    of rules are folded like those of URLs. Extra columns are not read. Empty tables: no rows,
    or `default` for every page.
    """
    rules = rules.select(
        F.translate("host", *FOLD).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host <> ''")
    rules = rules.select(
        "r_verdict",
        F.concat("r_host", "r_path").alias("r_rule"),
        F.length("r_path").alias("r_len"),
        F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256).alias("r_digest"),
    ).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
    profile = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("r_len")).alias("lengths")).first()
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    keyed = keyed.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    lengths = F.array(*(F.lit(n) for n in profile["lengths"])) if profile["lengths"] else F.array().cast("array<int>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    expressions = F.flatten(
        F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat_ws("\n", s, F.substring(F.col("path"), F.lit(1), n))))
    )
    # expanded and met where the pages are read; one empty expression a row keeps and counts the rows
    spread = keyed.withColumn("expression", F.explode(F.concat(expressions, F.array(F.lit("")))))
    spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    side = F.broadcast(rules) if profile["n"] <= BROADCAST_RULES else rules
    met = spread.join(side, F.col("prefix") == F.col("r_prefix"), "left")
    hit = F.col("digest") == F.col("r_digest")
    rank = F.struct(
        F.when(hit, F.length("r_rule")).otherwise(-1).alias("length"),
        (F.col("r_verdict") != "block").alias("mild"),
        F.col("r_rule").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    # longest first: min over negated length
    rank = F.struct((-rank["length"]).alias("short"), rank["mild"].alias("mild"), rank["rule"].alias("rule"), rank["verdict"].alias("verdict"))
    best = met.groupBy("id", "url", "host", "path").agg(
        F.count_if(F.col("expression") == "").alias("copies"), F.min(F.when(hit, rank)).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
