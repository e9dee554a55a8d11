"""URL filters: exact membership in a list by a cascade of Bloom filters, as DataFrame functions.

Level 1 holds the listed keys. Level 2 holds the keys of the corpus that level 1 takes in
wrongly, level 3 the listed keys that level 2 takes in, and so on until a level takes in
nothing wrongly. Level 1's rate of false positives is the list's share of the corpus's keys, so
level 2 has about as many keys as the list, however large the corpus is, and level 1 grows with
the logarithm of the corpus. Over the keys the cascade was built for, it is exact, and a query is
a few bit tests in one expression: no join, no shuffle.

A rule is a host and a path prefix; a url's keys are its host's suffixes with its path's
prefixes of those lengths that some rule has.

A list of more than MOST_RULES rules, too long to stand in a query's plan, is joined with the
corpus's distinct urls instead: the same verdicts, by a shuffle.

Nulls and urls without "://" have an empty host and path and fit no rule. Duplicate rules count
once; a rule listed as both allow and block is refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import join_hot, written

#: Most listed rules whose filters, of a few bytes a rule, stand in the query's plan.
MOST_RULES = 100_000
#: Most hash functions of a filter.
MOST_HASHES = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bloom:
    """Bits of a filter in 64-bit words."""

    words: tuple[int, ...]
    seeds: tuple[int, ...]

    def contains(self, key: Column) -> Column:
        words = F.lit(list(self.words))
        bits = [F.pmod(F.xxhash64(key, F.lit(s)), F.lit(64 * len(self.words))) for s in self.seeds]
        tests = [F.get(words, F.shiftright(b, 6).cast("int")).bitwiseAND(_bit(b)) != 0 for b in bits]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def build_bloom(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A filter over the column `key` of keys, n of them, with so high a rate of false positives at most."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    n_hashes = min(MOST_HASHES, max(1, round(bits / n * math.log(2))))
    seeds = tuple(1000 * level + i for i in range(n_hashes))
    places = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(s)), F.lit(bits)) for s in seeds])).alias("place"))
    rows = places.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Bloom(tuple(words), seeds)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def contains(self, key: Column) -> Column:
        """The first level that rejects the key decides: an odd one says no, an even one yes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].contains(key), F.lit(i % 2 == 0)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
    """listed, universe: DataFrames with a column key; how many distinct keys each has, the universe about.

    The universe is scanned once: what level 1 lets through is written down and is about as
    large as the list; the levels after that look at it alone.
    """
    rate = min(0.5, max(2.0**-MOST_HASHES, math.sqrt(0.5) * n_listed / max(n_universe, 1)))
    levels = [build_bloom(listed, n_listed, rate, 1)]
    wrong = universe.where(levels[0].contains(F.col("key"))).distinct().join(listed, "key", "left_anti")
    sides = [listed, written(wrong, "bloom")]
    while True:
        inside = sides[len(levels) % 2]
        for i in range(2 - len(levels) % 2, len(levels) + 1, 2):
            if i > 1 or len(levels) % 2 == 0:
                inside = inside.where(levels[i - 1].contains(F.col("key")))
        n = inside.count()
        if not n:
            return Cascade(tuple(levels))
        levels.append(build_bloom(inside, n, 0.5, len(levels) + 1))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: host after the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? or #."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """All (host suffix, path prefix) pairs that a rule could be, as one string each."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    starts = F.sequence(F.greatest(F.lit(1), n - labels + 1), n)
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(path)), lambda x: F.substring(path, F.lit(1), x))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _filter_by_join(own: DataFrame, verdicts: dict[str, str], lengths: list[int], labels: int, otherwise: str) -> DataFrame:
    """As filter_urls, for lists of any length: the keys of distinct (host, path) meet the rules in a join."""
    rules = own.sparkSession.createDataFrame(list(verdicts.items()), "key string, verdict string")
    places = written(own.groupBy("host", "path").agg(F.count("*").alias("pages")), "places")
    keys = places.select("host", "path", F.explode(url_keys(F.col("host"), F.col("path"), lengths, labels)).alias("key"))
    met = written(keys.groupBy("key").agg(F.count("*").alias("places")).join(rules, "key"), "rules")
    hit = join_hot(keys, met, ["key"], "places").where("verdict is not null")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("length"), F.col("key").alias("rule"), "verdict")).alias("best"))
    judged = written(places.join(best, ["host", "path"]), "judged")
    return join_hot(own, judged, ["host", "path"], "pages").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits it.

    rules: (verdict allow or block, host, path). Returns page_id, host, path, rule (host and path
    of the rule, else null) and verdict: the rule's, else `otherwise` - what is not listed.
    """
    spark = pages.sparkSession
    verdicts: dict[str, str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or verdicts.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"rule {host}{path}: {verdict}")
    h, p = split_url(F.col("url"))
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).select("page_id", h.alias("host"), p.alias("path"))
    lengths, labels = sorted({len(p) for _, _, p in rules}), max([h.count(".") + 1 for _, h, _ in rules], default=1)
    if len(verdicts) > MOST_RULES:
        return _filter_by_join(own, verdicts, lengths, labels, otherwise)
    keyed = own.select("page_id", "host", "path", url_keys(F.col("host"), F.col("path"), lengths, labels).alias("keys"))
    universe = keyed.select(F.explode("keys").alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0] if verdicts else 0
    fits = {}
    for verdict in ("allow", "block"):
        keys = [k for k, v in verdicts.items() if v == verdict]
        if keys:
            listed = spark.createDataFrame([(k,) for k in keys], "key string")
            fits[verdict] = build_cascade(listed, universe, len(keys), n_universe)
    if not fits:
        return own.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    judged = F.transform(
        "keys", lambda k: F.struct(F.length(k).alias("length"), k.alias("rule"), F.coalesce(*[F.when(c.contains(k), F.lit(v)) for v, c in fits.items()]).alias("verdict"))
    )
    best = F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull()))
    return keyed.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
