"""URL filtering with native expressions only.

Every URL is split into host and path. A short list of rules decides first: a rule ``host/path`` fits its host,
all subdomains of it and every path that starts with its own; the longest fitting rule wins (of equally long
ones the first in code point order). What no rule decides is looked up in a list of canonical URLs: a blocked
Bloom filter passes the possible hits, and only these meet the list in an exact hash join that removes the false
positives; all other pages are decided where they lie.

The filter: a key's XXH64 picks one block of four 64-bit words, and four more hash bytes pick one bit in each
word, so a probe touches one cache line. The list's size bounds the filter: at ``KEYS_A_BLOCK`` keys for 32
bytes it is a scalar subquery of at most ``MAX_FILTER_BYTES``. For a longer list the number of blocks stays at
that bound: more false positives pass, and the exact join removes them all the same. The exact join broadcasts
the list only where its measured bytes stay under ``MAX_BROADCAST_BYTES``; else it is a shuffled join.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. An
empty list allows all that the rules leave. Null and repeated list entries count once. Repeated pages are judged
each by itself; the pages' own columns pass through under their names, whatever these are, but for names of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialise

KEYS_A_BLOCK = 16
MAX_FILTER_BYTES = 16 << 20
MAX_BROADCAST_BYTES = 16 << 20
MAX_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest))
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without a default port and a leading ``www.``, ``m.`` or ``blog.``."""
    return F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"^(www|m|blog)\.", "")


def canonical_url(host: Column, path: Column) -> Column:
    """``host/path`` without scheme, query, fragment, index page and closing slashes; a bare host ends in one."""
    tail = F.regexp_replace(F.regexp_replace(path, r"/index\.html?\z", ""), r"/+\z", "")
    return F.concat(canonical_host(host), F.when(tail == "", F.lit("/")).otherwise(tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, null where none fits. rules: (``host/path``, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; keep longer lists in the table of listed URLs")
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(set(rules), key=lambda r: (-len(r[0]), r[0]), reverse=True):  # the last one wrapped is asked first
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        found, verdict = F.when(fits, F.lit(text)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit for each of a block's four words."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(4)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with one array of ``4 * blocks`` longs. ``keys``: one string column ``key``."""
    names = [f"w{i}" for i in range(4)]
    by_block = keys.select(_block(F.col("key"), blocks).alias("b"), *[x.alias(w) for w, x in zip(names, _bits(F.col("key")))])
    by_block = by_block.groupBy("b").agg(*[F.bit_or(w).alias(w) for w in names])
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("at"))
    filled = every.join(by_block, F.col("at") == F.col("b"), "left").select("at", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in names])
    # Structs sort by their first field, so that each block's words end up at its number.
    placed = filled.agg(F.sort_array(F.collect_list(F.struct("at", F.array(*names).alias("words")))).alias("placed"))
    return placed.select(F.flatten(F.col("placed.words")).alias("words"))


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter may hold the key: never false for a key it holds."""
    at = _block(key, blocks) * 4
    probe = F.lit(True)
    for i, bit in enumerate(_bits(key)):
        probe = probe & (F.get(words, at + i).bitwiseAND(bit) != 0)
    return probe


RESULT = ("host", "path", "url_key", "site_key", "rule", "listed", "verdict")


def parted(pages: DataFrame, keys: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Pages that rules or the filter have decided, and possible hits that the list itself must decide.

    Both: ``page`` (the row as it came), host, path, url_key, site_key, rule, and the rule's own verdict. The filter is built
    once and stored.
    """
    blocks = max(1, min(-(-keys.count() // KEYS_A_BLOCK), MAX_FILTER_BYTES // 32))
    words = materialise(bloom_filter(keys, blocks), "filter").scalar()
    host, path = host_and_path(F.col("page")[url])
    split = pages.select(F.struct("*").alias("page")).select("page", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.select("*", canonical_url(F.col("host"), F.col("path")).alias("url_key"), F.concat(canonical_host(F.col("host")), F.lit("/")).alias("site_key"), rule.alias("rule"), verdict.alias("rule_verdict"))
    hit = may_hold(words, F.col("url_key"), blocks) | may_hold(words, F.col("site_key"), blocks)
    possible = F.col("rule").isNull() & (F.col("host") != "") & hit
    return judged.where(~possible), judged.where(possible)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", entry: str = "url") -> DataFrame:
    """``pages`` with host, path, url_key, site_key, rule, listed and verdict.

    A list entry is a canonical URL as ``canonical_url`` makes it; one that ends in ``/`` right after its host
    lists the whole site. ``listed`` is true where the page's URL or its site is on the list; it is false, unasked, where a rule decides.
    """
    keys = materialise(listed.select(F.col(entry).alias("key")).where("key is not null").distinct(), "listed")
    size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0]
    decided, asked = parted(pages, keys, rules, url)
    for key in ("url", "site"):
        side = keys.select(F.col("key").alias(f"{key}_entry"))
        asked = asked.join(F.broadcast(side) if size <= MAX_BROADCAST_BYTES else side, F.col(f"{key}_key") == F.col(f"{key}_entry"), "left")
    asked = asked.withColumn("listed", F.col("url_entry").isNotNull() | F.col("site_entry").isNotNull()).drop("url_entry", "site_entry")
    every = decided.withColumn("listed", F.lit(False)).unionByName(asked)
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    own = [F.col("page")[c].alias(c) for c in pages.columns if c not in RESULT]
    return every.select(*own, *RESULT[:-1], verdict.alias("verdict"))
