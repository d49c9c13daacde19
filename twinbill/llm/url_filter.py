"""URL filter: a blocked Bloom filter before an exact hash join.

Listed canonical URLs set eight bits in one 256-bit block each. The filter is a
table of blocks, one row each, so it is built by a grouping and tested by a join
on the block number: broadcast if its size allows, shuffled if not. Only URLs
that pass go on to the exact join with the list, which removes the false
positives; all others are settled without being moved. Everything is made of
column functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, and path up to the query, after the first "://".
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class BloomSize:
    """Bits for each listed URL, and the largest filter that is sent to all executors."""

    bits_per_url: int = 16
    broadcast_bytes: int = 32 << 20


def host(url: Column) -> Column:
    """Lower-case host (A-Z only); empty for null and for a URL without "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host without a leading www. and path without slashes at its end."""
    return F.concat(F.regexp_replace(host_, r"^www\.", ""), F.regexp_replace(path_, "/+$", ""))


def fitting_rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_ == rule.host) | F.endswith(host_, F.lit("." + rule.host))) & F.startswith(path_, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _masks(url: Column) -> list[Column]:
    """The four 64-bit words that a URL sets in its block, eight bits in all."""
    bits = F.xxhash64(F.lit("bits"), url)
    places = [F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    one = F.lit(1).cast("long")
    return [
        reduce(
            Column.bitwiseOR,
            [
                F.when(
                    F.shiftrightunsigned(p, 6) == word,
                    F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int")),
                ).otherwise(F.lit(0).cast("long"))
                for p in places
            ],
        )
        for word in range(4)
    ]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), url), F.lit(blocks).cast("long"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w3) of the blocks that a listed ``canonical`` sets bits in."""
    with_masks = listed.select(
        _block(F.col("canonical"), blocks).alias("block"),
        *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("canonical")))],
    )
    return with_masks.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], size: BloomSize | None = None
) -> DataFrame:
    """Verdict on each row of ``pages`` (page_id, url).

    ``listed`` has a column ``canonical``; null and empty entries list nothing.
    Returns page_id, host, path, rule, verdict (the rule's; else block for a
    listed URL and allow for any other) and listed. Null URLs and those without
    "://" have an empty host and path, no rule, and are allowed. Null ids stay
    null, rows may repeat, other columns are ignored, empty tables are fine.
    """
    size = size or BloomSize()
    listing = materialize(
        listed.select("canonical").where("canonical is not null and canonical <> ''").distinct(), "listed"
    )
    blocks = max(1, -(-listing.count() * size.bits_per_url // 256))
    bloom = bloom_filter(listing, blocks).withColumnRenamed("block", "bloom_block")
    if blocks * 48 <= size.broadcast_bytes:
        bloom = F.broadcast(bloom)

    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parsed = parsed.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    hit = reduce(
        Column.__and__,
        [F.col(f"w{k}").bitwiseAND(m) == m for k, m in enumerate(_masks(F.col("canonical")))],
    )
    tested = (
        parsed.withColumn("bloom_block", _block(F.col("canonical"), blocks))
        .join(bloom, "bloom_block", "left")
        .select("page_id", "host", "path", "canonical", F.coalesce(hit, F.lit(False)).alias("possible"))
    )
    # A URL that many rows share is looked up once.
    possible = tested.where("possible").select("canonical").distinct()
    confirmed = possible.hint("shuffle_hash").join(listing, "canonical", "left_semi").withColumn("listed", F.lit(True))
    names = ["page_id", "host", "path"]
    settled = tested.where("not possible").select(*names, F.lit(False).alias("listed"))
    looked_up = (
        tested.where("possible")
        .join(confirmed, "canonical", "left")
        .select(*names, F.coalesce("listed", F.lit(False)).alias("listed"))
    )
    out = settled.unionByName(looked_up).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select(
        *names,
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
        "listed",
    )
