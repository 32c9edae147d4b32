"""URL rules: host suffixes and path prefixes, matched by hash prefix.

A URL is expanded into the expressions a rule could have been written as: a
suffix of its host at a label boundary, followed by a prefix of its path. The
expressions meet the rules in an equi-join on a short prefix of their SHA-256;
the whole digest then confirms a match and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewprobe.llm.common import ascii_lower, replaced
from skewprobe.session import stage

# Hex digits of the digest that the join compares: 32 bits.
PREFIX = 8
# A rule that many hosts meet (a whole top-level domain) is repeated so often,
# and its expressions are dealt over as many keys.
SALTS = 16
RULES = "host string, path string, action string"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action``. A rule fits its host and all
    its subdomains if the path of the URL starts with the rule's path. The
    longest rule wins, counted over host and path together; of equally long ones
    the longer host, then the smaller text, then the smaller action. Without a fitting
    rule ``rule`` is null and the verdict is ``default``. A URL that is null,
    empty or without ``://`` has an empty host and path, which no rule fits;
    rules with a null host are left out, a null path fits every path, a null
    action counts as ``default``. Repeated rows are judged each. Columns of
    ``pages`` with the names of the result are replaced, all others are kept.
    """
    pages = replaced(pages, {"host": url_host(F.col(f"`{url}`")), "path": url_path(F.col(f"`{url}`"))})
    listed = _listed(rules, default)
    shapes = listed.select("labels", "length").distinct()
    # Hosts and paths are judged once, however many rows repeat them.
    found = _match(pages.select("host", "path").distinct(), listed, shapes)
    best = stage(found, "url-rules")
    mine = best.select(
        F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best").alias("__best")
    )
    # No rule fits an empty host: such rows are dealt out, and meet nothing.
    apart = F.when(F.col("host") == "", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1).otherwise(0)
    spread = pages.withColumn("__apart", apart)
    mine = mine.withColumn("__none", F.lit(0))
    same = (spread["host"] == F.col("__h")) & (spread["path"] == F.col("__p"))
    joined = spread.join(mine, same & (spread["__apart"] == F.col("__none")), "left")
    out = replaced(
        joined,
        {
            "rule": F.col("__best.rule"),
            "verdict": F.coalesce(F.col("__best.action"), F.lit(default)),
        },
    )
    return out.drop("__h", "__p", "__best", "__apart", "__none")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash or line feed, so the pair can be told from its text.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _listed(rules: DataFrame, default: str) -> DataFrame:
    host = ascii_lower(F.col("host"))
    path = F.coalesce(F.col("path"), F.lit(""))
    action = F.coalesce(F.col("action"), F.lit(default))
    listed = rules.where("host is not null").select(
        host.alias("r_host"), path.alias("r_path"), action.alias("action")
    )
    listed = listed.groupBy("r_host", "r_path").agg(F.min("action").alias("action"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return listed.select(
        "action",
        F.concat("r_host", "r_path").alias("rule"),
        F.length("r_host").alias("r_len"),
        _labels(F.col("r_host")).alias("labels"),
        F.length("r_path").alias("length"),
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX).alias("short"),
    )


def _match(urls: DataFrame, listed: DataFrame, shapes: DataFrame) -> DataFrame:
    """The best rule of each (host, path) that has one."""
    # Only the shapes that rules have are expanded: one row, whose size is that
    # of the distinct (labels, path length) pairs and not of the rules.
    shape = F.collect_set(F.struct("labels", "length")).alias("shapes")
    expanded = urls.crossJoin(F.broadcast(shapes.agg(shape)))
    own, whole = F.split("host", r"\."), F.length("path")
    fitting = F.filter(
        "shapes", lambda s: (s["labels"] <= F.size(own)) & (s["length"] <= whole)
    )
    expression = F.transform(
        fitting,
        lambda s: _digest(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]),
            F.substring(F.col("path"), F.lit(1), s["length"]),
        ),
    )
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    exploded = expanded.where("host <> ''").select(
        "host", "path", salt.alias("salt"), F.explode(expression).alias("own")
    )
    salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    short = F.substring("own", 1, PREFIX)
    hits = exploded.withColumn("short", short).join(salted, ["short", "salt"]).where("own = digest")
    # The largest struct is the longest rule; min_by settles equal texts.
    rank = F.struct(
        (-(F.col("r_len") + F.col("length"))).alias("a"), (-F.col("r_len")).alias("b"), F.col("rule")
    )
    return hits.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "action"), rank).alias("best")
    )
