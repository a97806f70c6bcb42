"""URL filtering by a blocked Bloom filter and an exact hash join, in native expressions only.

Two lists. A rule `host/path` fits a URL whose host is the rule's host or one of its subdomains and
whose path starts with the rule's path; of the rules that fit, the longest wins. A listed canonical
URL blocks every page that no rule fits and whose URL has that canonical form, however it is written.

Probes meet a filter first: each key has one 256-bit block and one bit in each of the block's eight
words, so one lookup reads one block. What passes is joined with the list itself, which removes the
false positives. The filter takes `bits_per_key` bits per entry and is broadcast only while its size
is below `broadcast_bytes`; beyond that the same join shuffles by block. A URL is probed only for
the lengths of the rules of its own hosts, which an equi-join finds.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits nothing and is
allowed; empty lists allow all; repeated rows are judged alike; other columns are not read. A rule
without `/` is its host with every path; null rules are none; capitals in a rule's host are lowered;
of rules listed twice the one that blocks holds; of different rules of one length the greater wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm.bloom import BITS_PER_KEY, BROADCAST_BYTES, possible_hits

_SPREAD = 1024


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form that variants of one address share: no `www.` or `m.`, no default port, no `/` or `.html` at the end; scheme, query and fragment are gone already."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)\z", ""), F.regexp_replace(path, r"(/|\.html)\z", ""))


def canonical_url(url: Column) -> Column:
    return canonical(host_of(url), path_of(url))


def _entries(rules: DataFrame) -> DataFrame:
    """Rows (key, host, n, rule, rule_verdict) of the rules: n is the length of the path."""
    host = _lower(F.substring_index("rule", "/", 1))
    path = F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")
    kept = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))
    return kept.select(F.concat(host, path).alias("key"), host.alias("host"), F.length(path).alias("n"), "rule", "rule_verdict")


def _ruled(urls: DataFrame, entries: DataFrame, bits_per_key: int, broadcast_bytes: int) -> DataFrame:
    """Rows (host, path, rule, rule_verdict) of the URLs that a rule fits."""
    lengths = entries.groupBy(F.col("host").alias("suffix")).agg(F.collect_set("n").alias("lengths"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    under = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(lengths, "suffix")
    cut = under.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    probes = cut.select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("key"))
    hits = possible_hits(probes, entries.select("key"), bits_per_key, broadcast_bytes).join(entries.drop("host"), "key")
    best = F.max(F.struct(F.length("rule"), F.col("rule"), F.col("rule_verdict"))).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_verdict")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = BITS_PER_KEY, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. rules: rows (rule, verdict). listed: rows (url), canonical; none by default."""
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Rows without a host find nothing; they are dealt out, so that they don't meet in one task.
    judged = judged.withColumn("spread", F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(_SPREAD)).cast("int") + 1).otherwise(0))
    urls = judged.select("host", "path").distinct().where("host <> ''")
    found = _ruled(urls, _entries(rules), bits_per_key, broadcast_bytes).withColumn("blocked", F.lit(None).cast("string"))
    if listed is not None:
        keys = listed.select(F.col("url").alias("key")).where("key is not null").distinct()
        hits = possible_hits(urls.withColumn("key", canonical(F.col("host"), F.col("path"))), keys, bits_per_key, broadcast_bytes).join(keys, "key")
        own = hits.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"), F.lit("block").alias("blocked"))
        found = found.unionByName(own).groupBy("host", "path").agg(*[F.max(c).alias(c) for c in ("rule", "rule_verdict", "blocked")])
    out = judged.join(found.withColumn("spread", F.lit(0)), ["host", "path", "spread"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "blocked", F.lit("allow")).alias("verdict"))


def repeated_urls(pages: DataFrame, more_than: int = 1, url_col: str = "url") -> DataFrame:
    """Rows (url): canonical URLs that more than `more_than` pages have, of pages with a host."""
    urls = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).where("host <> ''")
    counted = urls.groupBy(canonical(F.col("host"), F.col("path")).alias("url")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > more_than).select("url")
