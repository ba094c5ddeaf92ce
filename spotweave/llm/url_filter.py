"""URL rules found by hashed host-suffix and path-prefix expressions.

Each URL expands into (host suffix, path prefix) expressions: one suffix per
number of labels that any rule's host has, one prefix per length that any
rule's path has, so that a host of many labels costs no more than its length.  A short hash prefix of
each expression meets the rules in an equi-join; the full digest confirms, and
the longest rule decides (host first, then path; equal rules: block wins).

Nulls: a null url, or one without ``://``, has empty host and path and fits no
rule.  A host ending in a dot keeps its empty last label.  A rule with a null or
empty host, or a null path, fits nothing.  Extra columns pass through
untouched when ``keep`` names them.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rules are broadcast up to this many rows (about 100 bytes each); more of them join by shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of the digest in the equi-join.
SHORT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The suffixes of the given numbers of labels that the host has (of 1 and 2, ``a.b.c`` gives ``c`` and ``b.c``); an empty host has none."""
    held = F.when(host == "", 0).otherwise(labels_of(host))
    return F.flatten(F.array(*[F.when(held >= n, F.array(F.substring_index(host, ".", -n))).otherwise(F.array().cast("array<string>")) for n in labels]))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of the given lengths that the path has."""
    return F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash, so the pair can be read back from the joined text.
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: id, host, path, the deciding rule (null: none fits) and its verdict (none: ``default``).

    ``rules``: host, path, action; they are a configured list.  Pages join by a
    broadcast of the rules below ``BROADCAST_RULES`` rows.  Beyond it, distinct
    expressions are looked up once each and their answers joined back, so that
    a host with many pages costs one lookup.
    """
    rules = (
        rules.where((F.col("host") != "") & F.col("path").isNotNull())
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("action").alias("r_action"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("r_digest", 1, SHORT))
    )
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect()) or [0]
    labels = sorted(r[0] for r in rules.select(labels_of(F.col("r_host"))).distinct().collect()) or [1]
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    base = pages.select(
        F.col(id_col).alias("id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    exprs = F.flatten(
        F.transform(
            host_suffixes(F.col("host"), labels),
            lambda h: F.transform(path_prefixes(F.col("path"), lengths), lambda p: F.struct(h.alias("h"), p.alias("p"))),
        )
    )
    keyed = (
        base.select("*", F.explode_outer(exprs).alias("e"))
        .select("id", "host", "path", "row", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    # The longest host decides, then the longest path: the struct's order is the precedence.
    rank = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), "r_host", "r_path", "r_action")
    if few:
        hit = keyed.join(F.broadcast(rules), "short", "left").withColumn("best", F.when(F.col("r_digest") == F.col("digest"), rank))
    else:
        known = keyed.select("digest", "short").where("digest is not null").distinct().join(rules, "short")
        known = known.where(F.col("r_digest") == F.col("digest")).select("digest", rank.alias("best"))
        hit = keyed.join(known, "digest", "left")
    out = hit.groupBy("row", "id", "host", "path").agg(F.max("best").alias("best"))
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce("best.r_action", F.lit(default)).alias("verdict"),
    )
