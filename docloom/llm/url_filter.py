"""URL filter: host-suffix / path-prefix expressions joined to rules on short hash prefixes.

Native: DataFrame functions only. Each distinct URL is expanded into (host suffix, path prefix)
expressions; both sides are hashed with SHA-256 and joined on the first four bytes; the full digest,
and then the rule itself, confirm a match; the longest rule wins.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there
up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path. Path
prefixes are the empty one and those cut after each ``/``: a rule is filed under its path up to the last ``/`` and the rest
of it is confirmed after the join, so a rule need not end at a segment.

Defined results: one row for each input row, repeated rows included; a URL that no rule fits gets a
null rule and the default verdict; of rules equally long, host rules with the longer host win, then
block before allow. An empty table or an empty rule list is fine. Only the id and URL columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(bare, F.length(host) + 1, F.length(bare))


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, of at most so many labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _prefixes(path: Column, most: int) -> Column:
    """The empty prefix, and every prefix of the path that ends with a slash, of at most so many characters."""
    cuts = F.split(F.substring(path, 1, most), "/")
    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(cuts, 1, i), "/"), F.lit("/"))))


def _hashed(df: DataFrame, expr: Column) -> DataFrame:
    full = F.sha2(expr, 256)
    return df.withColumn("digest", full).withColumn("short", F.substring(full, 1, 8))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table of constants, of a size that Spark knows."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<verdict:string,host:string,path:string>>")))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule (host and path of the rule that decides, or null), verdict."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    # Dealt by URL, so that all tasks take part in expanding and hashing, however small the URLs are.
    rows = base.count()
    urls = base.select("url").where("url is not null").repartition(parts_for(rows, 5_000), "url").distinct().select("url", host.alias("host"), path.alias("path"))
    known = rules.select(F.col("verdict").alias("rule_verdict"), F.translate(F.col("host"), UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).where("rule_host is not null and rule_path is not null")
    # No expression longer than the rules can match any, so a very long URL is not expanded further.
    longest = known.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.length("rule_path"))).first()
    labels, letters = longest[0] or 1, longest[1] or 0
    pairs = urls.select("url", "host", "path", F.explode(_suffixes(F.col("host"), labels)).alias("suffix")).select("url", "path", "suffix", F.explode(_prefixes(F.col("path"), letters)).alias("prefix"))
    asked = _hashed(pairs, F.concat("suffix", "prefix"))
    kept_path = F.regexp_extract(F.col("rule_path"), "^(.*/)", 1)
    known = _hashed(known, F.concat("rule_host", kept_path)).withColumnRenamed("digest", "rule_digest").withColumnRenamed("short", "rule_short")
    # Equi-join on the short prefix; everything after it confirms.
    hit = asked.join(known, F.col("short") == F.col("rule_short"), "inner").where("digest = rule_digest and suffix = rule_host and startswith(path, rule_path)")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    # Stored, so that the join deals both sides anew and a URL that very many rows share can be split; never
    # broadcast, as it grows with the pages.
    best = stored(hit.groupBy("url").agg(F.max(rank).alias("best")), "best")
    out = base.where("url is not null").join(best.hint("merge"), "url", "left").unionByName(base.where("url is null").select("url", "id", F.lit(None).cast(best.schema["best"].dataType).alias("best")))
    host, path = url_parts(F.col("url"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
