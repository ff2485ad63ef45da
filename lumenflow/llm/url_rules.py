"""Judge URLs by allow and block rules on host suffixes and path prefixes.

A URL is expanded into expressions "host suffix + path prefix", as deep as any rule goes. They meet
the rules in an equi-join on the first bytes of a digest; the full digest confirms a match, and the
longest matching rule decides. Distinct URLs are judged once, so a hot URL costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8  # hex digits of the short key


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules ``(verdict, "host/path/")`` as a table (verdict, rule). A rule's path ends with ``/``."""
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or not rule.endswith("/"):
            raise ValueError(f"not a rule: {verdict} {rule}")
    rows = ", ".join("('{}', '{}')".format(v, r.replace("'", "''")) for v, r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, rule)")


def expressions(host: Column, path: Column, labels: Column, depth: Column) -> Column:
    """Host suffixes of at most ``labels`` labels, each with every path prefix of at most ``depth`` slashes."""
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    count = F.least(F.size(parts), labels)
    hosts = F.transform(F.sequence(F.lit(1), count), lambda k: F.concat_ws(".", F.slice(parts, F.size(parts) - k + 1, k)))
    last = F.least(F.size(steps) - 1, depth)
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), last), lambda k: k > 0),
        lambda k: F.concat(F.concat_ws("/", F.slice(steps, F.lit(1), k)), F.lit("/")),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """The rows of ``pages`` as struct ``row`` with host, path, rule (null if none fits) and verdict.

    The longest fitting rule wins; of one rule given twice with both verdicts, ``block`` wins. Pages
    that no rule fits, null and malformed URLs among them, get ``otherwise``. Repeated rows stay.
    """
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict")).filter(F.col("rule").isNotNull())
    keyed = rules.select("rule", "verdict", F.sha2("rule", 256).alias("rule_digest"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, PREFIX))
    host = F.substring_index("rule", "/", 1)
    reach = rules.agg(
        F.coalesce(F.max(F.size(F.split(host, r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("rule", "/")) - 1), F.lit(0)).alias("depth"),
    ).first()  # two numbers
    rows = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    parsed = pages.select(rows, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = parsed.filter("host <> '' AND path <> ''").select("host", "path").distinct()
    spread = places.select(
        "host",
        "path",
        F.explode(expressions(F.col("host"), F.col("path"), F.lit(reach.labels), F.lit(reach.depth))).alias("expr"),
    )
    spread = spread.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    hits = spread.join(keyed, "short").filter(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best")
    )
    found = parsed.join(best, ["host", "path"], "left")
    return found.select(
        "row",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"),
    )
