"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule lists of at most so many rows are broadcast; longer ones join by a shuffle on the short hash.
BROADCAST_RULES = 100_000

#: Hexadecimal digits of a digest that the join compares.
SHORT = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    # (?s) lets a line feed be part of a host. lower() alone would touch letters beyond A-Z.
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of the path that have one of the lengths that occur in rules."""
    tried = F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n)))
    return F.array_compact(tried)


def expression(host: Column, path: Column) -> Column:
    """What is hashed; a NUL separates the two, so that no other pair reads the same."""
    return F.concat(host, F.lit("\x00"), path)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's url by the longest fitting rule.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's
    path starts with the rule's path. Of the rules that fit, the one with the longest host plus
    path wins, then the longest host, then the smallest verdict, so that ``allow`` comes before
    ``block`` if a rule is listed with both. Where no rule fits, the verdict is ``default``.

    Returns ``row`` (the input row), host, path, rule (host and path joined, else null), verdict.

    * a null url, or one without ``://``, has an empty host and path and the default verdict
    * rows that repeat are judged each on its own; an empty table or no rules at all are fine
    * rules with a null host or path are ignored; repeated rules count once

    Plan: each url becomes its host suffixes times the prefixes of its path in the lengths that
    rules have (a list that is bounded by the longest rule, not by the number of rows). The
    expressions join the rules on a short hash prefix, the full digest confirms each hit, and
    one aggregate on the row's number, partial before the exchange, takes the longest. Rules are
    broadcast behind a count; beyond that, both sides are shuffled by the short hash.
    """
    clean = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null").distinct()
    lengths = sorted(r[0] for r in clean.select(F.length("r_path")).distinct().collect())
    n_rules = clean.count()
    digest = F.sha2(expression(F.col("r_host"), F.col("r_path")), 256)
    hashed = clean.withColumn("r_digest", digest).withColumn("short", F.substring("r_digest", 1, SHORT))

    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
        url_host(F.col(url_col).cast("string")).alias("host"),
        url_path(F.col(url_col).cast("string")).alias("path"),
        F.monotonically_increasing_id().alias("number"),
    )
    if not lengths:
        return rows.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(path_prefixes(F.col("path"), lengths), lambda p: F.sha2(expression(h, p), 256))))
    tried = rows.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.substring("digest", 1, SHORT))
    side = F.broadcast(hashed) if n_rules <= BROADCAST_RULES else hashed
    hits = tried.join(side, "short", "left")
    fits = F.col("r_digest") == F.col("digest")
    size, host_size = F.octet_length("r_host") + F.octet_length("r_path"), F.octet_length("r_host")
    rank = F.struct((-size).alias("a"), (-host_size).alias("b"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("number", "row", "host", "path").agg(F.min(F.when(fits, rank)).alias("best"))
    return best.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
