"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

Listed are rules (host, path prefix, verdict), which hold for a host and all its subdomains, and whole URLs.  Each
becomes one canonical key: `r|host|path` or `u|host/path`.  A URL has one candidate key for each of its host's suffixes
and each rule-path length in the list, and one for itself.  All candidates are probed against the filter inside the
task that made them; only possible hits reach the hash join, which compares whole keys and so removes the filter's false
positives.  The longest rule that fits decides; then a listed whole URL blocks; then the default.

Whole URLs are compared in one canonical form on both sides: host in lower case without `www.`, default port and final
dot; percent-escapes of the path resolved; no query, fragment or final slashes.

Scale: URLs are reduced to distinct (host, path) before anything is exploded, so a host or URL that holds a third of
all rows is one row here.  The filter's blocks are 256-bit rows keyed by block number, and the filter is always broadcast:
it has `most_blocks` blocks at most (some 30 MB).  Longer lists get fewer bits a key, so more false positives for the exact
join and no other plan.  The final join to pages is on (host, path), where adaptive execution can split a hot key.

Defined cases: urls of any length are taken whole; null urls and urls without `://` have an empty host and path and get the default verdict; repeated rows
each return a row; an empty list gives the default to all; extra columns of the input are ignored, and `keep` may not name a result's column; a rule listed twice
counts once (of contradicting duplicates the block wins); of equally long rules the smaller string wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER

#: The rules of the production query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Whole URLs blocked by the production query, beside its rules: a few, the pages of listed sites, and addresses of campaigns.
LISTED = ("ads.example.org/click", "tracker.example.com/pixel", "mirror.example.org/spam")
SITES, CAMPAIGNS = ("casino-win", "free-bets", "cheap-pills"), 200_000
BITS_PER_KEY, WORDS_PER_BLOCK, PROBES = 24, 4, 6


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(host: Column, path: Column) -> Column:
    """The form in which whole URLs are compared."""
    name = F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, UPPER.lower()), r":(80|443)?$", ""), r"^www\.|\.$", "")
    plain = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    return F.concat(name, F.regexp_replace(plain, "/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """For each 64-bit word of a block the bits that a key sets there."""
    h = F.xxhash64(key, F.lit(7))
    spots = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(64 * WORDS_PER_BLOCK - 1)) for i in range(PROBES)]
    one = lambda s, w: F.when(F.floor(s / 64) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(s, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return [reduce(lambda a, b: a.bitwiseOR(b), (one(s, w) for s in spots)) for w in range(WORDS_PER_BLOCK)]


def build_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a blocked Bloom filter over column `key`."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def listed_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, rule (null for whole URLs), verdict, size.  rules: host, path, verdict; listed: url (`host/path`)."""
    one = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return one.select(F.concat(F.lit("r|"), "host", F.lit("|"), "path").alias("key"), rule.alias("rule"), "verdict", F.length(rule).alias("size")).unionByName(
        listed.where(F.col("url").isNotNull()).select(F.concat(F.lit("u|"), canonical_url(F.regexp_extract("url", r"^[^/]*", 0), F.regexp_extract("url", r"(?s)^[^/]*(.*)", 1))).alias("key")).distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("size"))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame, *, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", most_blocks: int = 1 << 19) -> DataFrame:
    """keep columns, host, path, rule, verdict, decided_by ('rule', 'list' or 'default') for each row of urls."""
    keys = listed_keys(rules, listed)
    n_keys = keys.count()
    lengths = sorted(r[0] for r in rules.where(F.col("host").isNotNull()).select(F.length("path")).distinct().where(F.length("path").isNotNull()).collect())
    blocks = min(most_blocks, max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS_PER_BLOCK))))
    parts = urls.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    pairs = parts.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    ruled = F.flatten(F.transform("suffixes", lambda s: F.transform("heads", lambda p: F.concat(F.lit("r|"), s, F.lit("|"), p))))
    whole = F.concat(F.lit("u|"), canonical_url(F.col("host"), F.col("path")))
    shaped = pairs.select("host", "path", suffixes.alias("suffixes"), F.filter(heads, lambda p: p.isNotNull()).alias("heads"))
    shaped = shaped.select("host", "path", F.concat(ruled, F.array(whole)).alias("candidates"))
    loose = shaped.select("host", "path", F.explode("candidates").alias("key")).withColumn("block", _block(F.col("key"), blocks))
    met = loose.join(F.broadcast(build_bloom(keys, blocks)), "block")
    hits = met.where(reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("key")))])).select("host", "path", "key")
    exact = hits.join(keys, "key")
    best = exact.groupBy("host", "path").agg(F.min(F.struct((-F.col("size")).alias("size"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = parts.join(best, ["host", "path"], "left")
    decided = F.when(F.col("rule").isNotNull(), "rule").when(F.col("verdict").isNotNull(), "list").otherwise("default")
    return out.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), decided.alias("decided_by"))


def default_lists(spark) -> tuple[DataFrame, DataFrame]:
    """The rules, and the URLs that don't hang on any table."""
    campaigns = spark.range(CAMPAIGNS).select(F.format_string("WWW.offer%d.example.net:80/deal/%d/", F.col("id") % 997, "id").alias("url"))
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string").unionByName(campaigns)


def urls_of_sites(urls: DataFrame, url: str = "url") -> DataFrame:
    """url: whole URLs of the pages whose host has a label among SITES."""
    parts = urls.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return parts.where(F.arrays_overlap(F.split("host", r"[.:]"), F.array(*map(F.lit, SITES)))).select(F.concat("host", "path").alias("url")).distinct()
