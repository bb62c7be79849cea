"""URL filter: path rules, then a Bloom filter cascade for everything that no rule decides.

The cascade answers exactly whether a key is listed, for every key of a known universe: level 0 is a Bloom filter
of the listed keys, level 1 one of the other keys of the universe that level 0 lets through, level 2 one of the
listed keys that level 1 lets through, and so on until nothing is left. A key's level is the first filter without
it; listed keys leave at odd levels or last through. The universe is every host of the corpus with every suffix of it, so no
host is left to chance. A filter is one binary value that all its look-ups in the plan share: judging a row takes no join
and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: (kind, rule): a rule is a host, a slash and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Listed domains; they and their subdomains are blocked where no rule decides.
LISTED = ("free-bets.example.com", "cheap-pills.example.com", "spam-farm.example.org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class TooManyKeys(ValueError):
    """A level has more keys than a broadcast filter may hold."""


@dataclass
class Level:
    data: bytes  # bit n is bit n % 8 of byte n // 8
    hashes: int
    seed: int


def _bits(key: Column, seed: int, hashes: int, size: int) -> list[Column]:
    """Bit numbers of a key by double hashing."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key).bitwiseOR(F.lit(1))
    a, b = F.pmod(a, F.lit(size)), F.pmod(b, F.lit(size - 1)) + 1
    return [F.pmod(a + b * i, F.lit(size)) for i in range(hashes)]


def _in_level(key: Column, level: Level) -> Column:
    data = F.lit(level.data)
    byte = lambda bit: F.conv(F.hex(F.substring(data, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = [F.getbit(byte(bit), F.pmod(bit, F.lit(8)).cast("int")) == 1 for bit in _bits(key, level.seed, level.hashes, 8 * len(level.data))]
    return reduce(Column.__and__, hit)


def passes(key: Column, levels: list[Level]) -> Column:
    """Whether the cascade holds a key as listed; exact for keys of its universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~_in_level(key, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out if levels else F.lit(False)


def build(keys: DataFrame, key: str = "key", listed: str = "listed", bits_per_key: int = 8, hashes: int = 5, max_levels: int = 40, max_keys: int = 20_000_000) -> list[Level]:
    """Levels for distinct ``keys`` and their boolean ``listed``. What reaches the driver is bits_per_key bits for each
    listed key and a geometric tail of false positives; more than ``max_keys`` of them in a level raise ``TooManyKeys``."""
    scratch, levels = Scratch(keys.sparkSession), []
    rest = {True: keys.where(F.col(listed)).select(key), False: keys.where(~F.col(listed)).select(key)}
    for n in range(max_levels):
        side = n % 2 == 0
        own = scratch.table(rest[side], f"level{n}")
        count = own.count()
        if not count:
            return levels
        if count > max_keys:
            raise TooManyKeys(f"{count} keys in level {n}; a broadcast filter holds at most {max_keys}")
        data = np.zeros(max(8, -(-count * bits_per_key // 8)), np.uint8)
        bit = own.select(F.explode(F.array(*_bits(F.col(key), n, hashes, 8 * len(data)))).alias("bit"))
        ones = bit.groupBy((F.col("bit") / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("ones")).toArrow()
        data[ones["byte"].to_numpy()] = ones["ones"].to_numpy()
        levels.append(Level(data.tobytes(), hashes, n))
        inside = _in_level(F.col(key), levels[-1])
        rest[side], rest[not side] = own, rest[not side].where(inside)
    raise ValueError(f"false positives are left after {max_levels} levels")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (of equal length, blocks first), as a struct of rule and verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, listed=LISTED, id_col: str = "page_id", url_col: str = "url", max_keys: int = 20_000_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A level of the cascade holds at most ``max_keys`` keys, which bounds what is broadcast. Where one would hold more, hosts
    of the corpus meet the list in a join instead, and rows the hosts that are blocked; the result is the same.

    ``listed``: domains as a sequence, or as a DataFrame of one column for lists that do not fit the driver. Null
    urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Other columns are
    ignored; repeated rows are kept; no rows give no rows. Empty lists block nothing.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    if isinstance(listed, DataFrame):
        names = listed.select(F.col(listed.columns[0]).alias("key")).where("key is not null").distinct().withColumn("on", F.lit(True))
        keys = keys.join(names, "key", "full").select("key", F.coalesce("on", F.lit(False)).alias("listed"))
    elif listed:
        names = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in sorted(set(listed))))).alias("key"))
        keys = keys.unionByName(names).distinct().select("key", F.col("key").isin(list(listed)).alias("listed"))
    else:
        keys = keys.select("key", F.lit(False).alias("listed"))
    universe = Scratch(spark).table(keys, "universe")
    try:
        levels = build(universe, max_keys=max_keys)
        blocked = F.exists(suffixes(F.col("host")), lambda k: passes(k, levels))
    except TooManyKeys:
        own = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = own.join(universe.where("listed"), "key", "left_semi").select("host").distinct().withColumn("bad", F.lit(True))
        rows = rows.join(bad, "host", "left")  # one row a host on the right: adaptive execution splits a hot host's rows
        blocked = F.coalesce("bad", F.lit(False))
    found = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.when(F.col("found").isNotNull(), F.col("found.verdict")).otherwise(F.when(blocked, "block").otherwise("allow")).alias("verdict"))
