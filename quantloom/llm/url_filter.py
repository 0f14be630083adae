r"""URL filter: longest-prefix host and path rules, then a list of blocked URLs.

A blocked Bloom filter of the listed canonical URLs lets possible hits through
to an exact hash join on the canonical URL, which removes false positives.  The
filter is a table of blocks of eight 64-bit words; a URL belongs to one block,
so a probe reads one row.

Canonical form: host without a leading ``www.``, ``m.`` or ``blog.`` label, path
without a trailing slash, no scheme, query or fragment.

Defined results.  A null url, or one without ``://``, has empty host and path,
matches no rule, is never listed and is allowed.  Of fitting rules of the same
length the last in order of its text wins.  Null entries of the list are
ignored; repeated ones count once.  Repeated pages each get a row.  Columns
beside page_id and url are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import lower_ascii

#: Fixed rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
WORDS_PER_BLOCK = 8
BITS_PER_URL = 16
PROBES = 6
#: Blocks up to this many bytes are broadcast; beyond, the probe is a shuffled join.
BROADCAST_BYTES = 8 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, rest, 1)), F.regexp_extract(url, rest, 2)


def canonical_url(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_columns(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        at_host = (host == rule_host) | host.endswith("." + rule_host)
        name = rule_host + rule_path
        fits.append((len(name), name, verdict, at_host & path.startswith(rule_path)))
    rule = verdict_of = F.lit(None).cast("string")
    for _, name, verdict, fit in sorted(fits, key=lambda r: r[:2]):
        rule = F.when(fit, F.lit(name)).otherwise(rule)
        verdict_of = F.when(fit, F.lit(verdict)).otherwise(verdict_of)
    return rule, verdict_of


def _bit(probe, hashed: Column) -> Column:
    """Bit 0..511 of a probe: double hashing within the block."""
    low, high = hashed.bitwiseAND(F.lit(0x1FF)), F.shiftright(hashed, 9).bitwiseAND(F.lit(0x1FF)).bitwiseOR(F.lit(1))
    return (low + probe * high).bitwiseAND(F.lit(0x1FF)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the words' bits set by the canonical URLs of ``listed``."""
    hashed = listed.select(
        F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), F.xxhash64("canonical", F.lit(7)).alias("inner")
    )
    bits = hashed.select("block", F.explode(F.array(*[_bit(i, F.col("inner")) for i in range(PROBES)])).alias("bit"))
    words = [
        F.coalesce(
            F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)"))), F.lit(0).cast("long")
        )
        for w in range(WORDS_PER_BLOCK)
    ]
    return bits.groupBy("block").agg(*[w.alias(f"w{i}") for i, w in enumerate(words)]).select(
        "block", F.array(*[f"w{i}" for i in range(WORDS_PER_BLOCK)]).alias("words")
    )


def listed_hits(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct canonical URLs of ``pages`` that ``listed`` (column canonical) holds."""
    listed = listed.filter(F.col("canonical").isNotNull() & (F.col("canonical") != "")).distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS_PER_BLOCK)))
    table = bloom_blocks(listed, blocks)
    if blocks * (8 * WORDS_PER_BLOCK + 40) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    probed = (
        pages.select("canonical")
        .filter(F.col("canonical") != "")
        .distinct()
        .withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
        .withColumn("inner", F.xxhash64("canonical", F.lit(7)))
        .join(table, "block")
    )
    for i in range(PROBES):
        bit = _bit(i, F.col("inner"))
        word = F.element_at("words", F.shiftright(bit, 6) + 1)
        probed = probed.filter(F.call_function("getbit", word, bit.bitwiseAND(F.lit(63))) == 1)
    return probed.select("canonical").join(listed, "canonical", "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page.  ``listed`` has a column url."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "canonical", F.when(F.col("host") != "", canonical_url(F.col("host"), F.col("path")))
    )
    list_host, list_path = url_parts(F.col("url"))
    blocked = listed.select(canonical_url(list_host, list_path).alias("canonical"))
    hits = listed_hits(parts, blocked).withColumnRenamed("canonical", "hit")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return (
        parts.join(hits, F.col("canonical") == F.col("hit"), "left")
        .withColumn("listed", F.col("hit").isNotNull())
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))
        .select("page_id", "host", "path", "rule", "verdict", "listed")
    )


#: Fixed words of the categories that the query's block list is made of.
LISTED_WORDS = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "clickbait", "escort", "gambling", "jackpot",
    "lottery", "malware", "payday", "phishing", "pills", "poker", "porn", "roulette", "scam", "sex", "slots", "spam",
    "tracker", "tracking", "viagra", "warez", "xxx",
)


def blocked_urls(pages: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """A block list: every URL seen on a host that has one of the words between dots and hyphens."""
    host, _ = url_parts(F.col("url"))
    named = F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(x) for x in words]))
    return pages.select("url").filter(named).distinct()


def op9_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, blocked_urls(pages)).drop("listed")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
q AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
c AS (
  SELECT *, regexp_replace(host, '^(?:www|m|blog)\.', '') || regexp_replace(path, '/+$', '') AS canonical,
         list_has_any(string_split_regex(host, '[.-]'),
                      ['ads', 'adserver', 'adult', 'bet', 'bets', 'betting', 'casino', 'clickbait', 'escort', 'gambling', 'jackpot', 'lottery', 'malware', 'payday', 'phishing', 'pills', 'poker', 'porn', 'roulette', 'scam', 'sex', 'slots', 'spam', 'tracker', 'tracking', 'viagra', 'warez', 'xxx']) AS seed FROM q),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(v, rh, rp)),
f AS (
  SELECT c.*, (SELECT max_by(rh || rp, length(rh || rp)) FROM r
               WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule FROM c)
SELECT page_id, host, path, rule,
       coalesce((SELECT v FROM r WHERE rh || rp = rule),
                CASE WHEN canonical IN (SELECT canonical FROM c WHERE seed) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
