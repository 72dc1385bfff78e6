"""URL filters by hashed host-suffix / path-prefix expressions.

A rule (host, path, action) fits a URL when the URL's host is the rule's host or
a subdomain of it, and the URL's path starts with the rule's path.  Every rule is
filed under the expression *host + directory*, where the directory is its path up
to and with the last ``/``.  A URL is expanded into its host suffixes, and for
the suffixes that some rule names, into that suffix joined to each of its
directories.  Both steps are equi-joins on a short prefix of the expression's
sha-256 digest; the full digest confirms the hit, the rest of a rule's path is
compared as text, and the longest fitting rule wins.

A URL is expanded to the depths that some rule has, so the expansion is linear in
the URL however deep its path; suffixes that no rule names are gone before the
directories are listed.  A suffix such as ``com`` that most URLs share is a
hot join key: both joins are plain equi-joins without hints, so the rule side is
broadcast when Spark knows it to be small and skewed partitions are split else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that form the join key (32 bits).
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL.  Null, or no ``://``: both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _key(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_DIGITS)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with digests; action is ``allow`` or ``block``.

    Null host or path count as empty; a rule with an empty host fits nothing.
    Of rules with one host and path, ``block`` is kept."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    return (
        rules.select(host.alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("action"))
        .where(F.col("r_host") != "")
        .groupBy("r_host", "r_path").agg(F.max("action").alias("r_action"))
        .withColumn("r_digest", _digest(F.col("r_host"), _directory(F.col("r_path"))))
        .withColumn("r_key", _key(F.col("r_digest")))
    )


def _count(text: Column, sep: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))


def _depths(rules: DataFrame, text: Column, sep: str) -> list[int]:
    """How many separators the rules' texts have: as many numbers as there are different depths."""
    return sorted(r[0] for r in rules.select(_count(text, sep)).distinct().collect())


def _of_depths(text: Column, sep: str, depths: list[int], suffixes: bool = False) -> Column:
    """The prefixes that end with the n-th separator (the empty one: 0), or the suffixes that hold n of them, for the n of ``depths``."""
    if suffixes:
        parts = [F.when(_count(text, sep) >= n, F.substring_index(text, sep, -(n + 1))) for n in depths]
    else:
        parts = [F.when(_count(text, sep) >= n, F.concat(F.substring_index(text, sep, n), F.lit(sep))) if n else F.lit("") for n in depths]
    return F.array_compact(F.array(*parts).cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    ``rule`` is the longest fitting rule as host + path (ties: the longer host,
    then ``block``), else null; ``verdict`` is its action, else ``default``.

    A null URL, or one without ``://``, has an empty host and path and meets no
    rule.  Repeated rows and ids each keep their row.  Empty tables give no rows,
    no rules the default.  Other columns, whatever their names, are left out.
    """
    host, path = url_parts(F.col("u_url"))
    base = pages.select(F.col(id_col).alias("u_id"), F.col(url_col).alias("u_url"))
    base = base.withColumns({"u_host": host, "u_path": path})
    ready = prepare_rules(rules)

    # host suffixes that some rule names
    hosts = ready.select("r_host").distinct().withColumn("h_digest", _digest(F.col("r_host")))
    hosts = hosts.select(F.col("r_host").alias("h_host"), "h_digest", _key(F.col("h_digest")).alias("h_key"))
    suffix = base.where(F.col("u_host") != "").select(
        "u_url", "u_path", F.explode(_of_depths(F.col("u_host"), ".", _depths(ready, F.col("r_host"), "."), suffixes=True)).alias("s_host"))
    suffix = suffix.withColumn("s_digest", _digest(F.col("s_host")))
    named = suffix.join(hosts, (_key(F.col("s_digest")) == F.col("h_key"))
                        & (F.col("s_digest") == F.col("h_digest"))).select("u_url", "u_path", "s_host")

    # directories of the path under each of those suffixes
    dirs = _of_depths(F.col("u_path"), "/", _depths(ready, _directory(F.col("r_path")), "/"))
    exprs = named.select("u_url", "u_path", "s_host", F.explode(dirs).alias("s_dir"))
    exprs = exprs.withColumn("e_digest", _digest(F.col("s_host"), F.col("s_dir")))
    hits = exprs.join(ready, (_key(F.col("e_digest")) == F.col("r_key"))
                      & (F.col("e_digest") == F.col("r_digest"))
                      & F.startswith(F.col("u_path"), F.col("r_path")))

    # precedence; one row per distinct URL, combined before the shuffle
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("len"), F.length("r_host").alias("host_len"),
                    F.col("r_action").alias("action"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy(F.col("u_url").alias("b_url")).agg(F.max(rank).alias("b"))
    return base.join(best, F.col("u_url") == F.col("b_url"), "left").select(
        F.col("u_id").alias(id_col), F.col("u_host").alias("host"), F.col("u_path").alias("path"),
        F.col("b.rule").alias("rule"), F.coalesce(F.col("b.action"), F.lit(default)).alias("verdict"))
