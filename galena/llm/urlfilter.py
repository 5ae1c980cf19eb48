"""URL rules and exact block lists held in Bloom filter cascades. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import LOWER, UPPER, discard, materialize

class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Listed hosts: these and all their subdomains are blocked where no rule fits. SITES names them too, so SQL need not.
LISTED = ("cheap-pills.example.com", "casino-win.example.org", "free-bets.example.com", "spam-farm.example.org", "ads-track.example.org")
#: Listed sites: a domain of the corpus that starts with one of these labels is listed, whatever it ends in.
SITES = ("cheap-pills", "casino-win", "free-bets", "spam-farm", "ads-track", "adult-x")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all domains above it: a.b.c, b.c, c."""
    n = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split(host, r"\."), i, n), "."))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest fitting rule (of equally long ones the smaller), else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


class Cascade:
    """Exact membership of a list for all keys of a universe, without a join at query time.

    Level 1 holds the listed keys. Level 2 holds the universe's keys that level 1 takes wrongly, level 3 the listed keys
    that level 2 takes wrongly, and so on until none is left; a key's answer is the level that first turns it away.
    The build's only join marks the universe's listed keys.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """listed, universe: a column key; nulls and repeats are ignored. The levels hold about
        1.44 * log2(universe / listed) + 3 bits for each listed key, at any size."""
        listed = listed.select(F.col("key").cast("string").alias("_k")).where("_k IS NOT NULL").distinct()
        marked = universe.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
        marked = materialize(marked.join(listed, F.col("key") == F.col("_k"), "left").select("key", F.col("_k").isNotNull().alias("listed")), "url-universe")
        self.levels: list[bloom.Level] = []
        inside, outside = marked.where("listed").select("key"), marked.where("NOT listed").select("key")
        n, m = inside.count(), outside.count()
        made = [marked]
        while n:
            rate = min(0.5, max(1e-6, n * math.sqrt(0.5) / max(m, 1))) if not self.levels else 0.5
            level = bloom.fill(inside, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            inside, outside = materialize(outside.where(bloom.contains(F.col("key"), level)), "url-level"), inside
            made.append(inside)
            n, m = inside.count(), n
        discard(*made)

    def contains(self, key: Column) -> Column:
        """Whether key, of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(bloom.contains(key, self.levels[i - 1]), out).otherwise(F.lit(i % 2 == 0))
        return F.coalesce(out, F.lit(False))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    pages has url. The longest fitting rule decides; where none fits, a page is blocked if its host or a domain above
    it is in listed (column key), else allowed. A null url, or one without ://, has an empty host and path, so no rule
    fits it and it is allowed. Repeated rows stay; an empty table gives an empty table. The universe is every host
    of pages with the domains above it, gathered after hosts are made distinct, so that a hot host counts once.
    """
    hosts = pages.select(host_of(F.col("url")).alias("h")).distinct()
    universe = hosts.select(F.explode(suffixes(F.col("h"))).alias("key"))
    cascade = Cascade(listed, universe)
    new = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c not in new]
    out = pages.select(*rest, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    hit = F.exists(suffixes(F.col("host")), cascade.contains)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).select(*rest, *new)


def block_list(pages: DataFrame) -> DataFrame:
    """LISTED, and the hosts of pages and domains above them that are SITES with any ending; a column key."""
    named = pages.sparkSession.createDataFrame([(h,) for h in LISTED], "key string")
    hosts = pages.select(host_of(F.col("url")).alias("h")).distinct()
    keys = hosts.select(F.explode(suffixes(F.col("h"))).alias("key"))
    site = F.substring_index("key", ".", 1)
    return named.union(keys.where(site.isin(*SITES) & (site != F.col("key"))).distinct())


def query(pages: DataFrame) -> DataFrame:
    listed = block_list(pages)
    return judge(pages.select("page_id", "url"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\\.)({"|".join(SITES)})\\.') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
