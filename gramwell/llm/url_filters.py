"""URL filters: a cascade of Bloom filters over the corpus's whole key universe.

Level 0 encodes the listed keys. Level 1 encodes the keys of the universe that level 0 passes by
mistake, level 2 the listed keys that level 1 passes by mistake, and so on until a level makes no
mistake. A key of the universe is then judged exactly by the first level that rejects it, with bit
tests against literals and no join.

Only DataFrame functions are used. Level sizes follow the number of listed keys (about
1.44 * log2(universe / listed) bits each, and 1.44 bits a mistake afterwards), never the number of
rows. Filters above `max_filter_bytes` are not shipped as literals: `Cascade` then judges keys by a
left semi join, with the same result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.llm.store import written

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the op10 query: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is listed by the op10 query when one of its labels is one of these.
LISTED_LABELS = ("casino-win", "spam-farm", "cheap-pills", "free-bets", "adult-x", "ads-track")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWERED)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and each of its parents, longest first; none for an empty host."""
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host key joined to every path start of a length that some rule has."""
    hosts = host_keys(host)
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))


class Level:
    """One Bloom filter: m bits in 64-bit words, tested by hashes seeded with the level's number."""

    def __init__(self, number: int, m: int, hashes: int, words: list[int]):
        self.number, self.m, self.hashes, self.words = number, m, hashes, words

    @staticmethod
    def places(key: Column, number: int, m: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(number * 64 + h)), F.lit(m).cast("long")) for h in range(hashes)]

    @classmethod
    def of(cls, keys: DataFrame, n: int, number: int, false_rate: float) -> Level:
        """keys: column key, distinct, n of them. The words meet at the driver: m / 8 bytes."""
        hashes = max(1, round(-math.log2(false_rate)))
        m = 64 * max(1, math.ceil(n * hashes * 1.4427 / 64))
        bits = keys.select(F.explode(F.array(*cls.places(F.col("key"), number, m, hashes))).alias("b"))
        rows = bits.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("v")).collect()
        words = [0] * (m // 64)
        for r in rows:
            words[r["w"]] = r["v"]
        return cls(number, m, hashes, words)

    def passes(self, key: Column) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = [F.call_function("bit_get", F.get(held, F.shiftright(b, 6).cast("int")), (b % 64).cast("int")) == 1 for b in self.places(key, self.number, self.m, self.hashes)]
        return reduce(lambda x, y: x & y, tests)


class Cascade:
    """Exact membership in `listed` for every key of `universe`.

    listed, universe: DataFrames with a column key; nulls and repeats are ignored. Keys outside the
    universe may be judged wrongly. An empty list has no member.
    """

    def __init__(self, spark: SparkSession, listed: DataFrame, universe: DataFrame, max_filter_bytes: int = 64 << 20, most_levels: int = 64):
        listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
        universe = universe.select("key").where(F.col("key").isNotNull())
        self.levels: list[Level] = []
        self.listed, self.joined = listed, False
        n = listed.count()
        if not n:
            return
        total = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        rate = min(0.5, math.sqrt(0.5) * n / max(1, total - n, n))
        if n * -math.log2(rate) * 1.4427 / 8 > max_filter_bytes:
            self.joined = True
            return
        self.levels.append(Level.of(listed, n, 0, rate))
        # sides[0]: listed keys still passing; sides[1]: other keys still passing
        wrong = universe.where(self.levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti")
        sides, number = [listed, wrong], 1
        while True:
            mine = written(sides[number % 2], f"level{number}")
            n = mine.count()
            if not n:
                break
            if number >= most_levels or n * 1.4427 / 8 > max_filter_bytes:
                self.joined = True
                return
            level = Level.of(mine, n, number, 0.5)
            self.levels.append(level)
            sides[number % 2] = mine
            sides[1 - number % 2] = sides[1 - number % 2].where(level.passes(F.col("key")))
            number += 1

    def has(self, key: Column) -> Column:
        """Whether a key is listed: the level that first rejects it decides."""
        if self.joined:
            raise ValueError("the filters exceed their bound; use mark()")
        if not self.levels:
            return F.lit(False)
        out = F.lit((len(self.levels) - 1) % 2 == 0)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 1))
        return out

    def listed_of(self, df: DataFrame, keys: str, out: str, id_column: str | None = None) -> DataFrame:
        """df with `out`: those of the array column `keys` that are listed, in order.

        Bit tests; or beyond the size bound a join of the exploded keys of each distinct array, spread
        by AQE where a key is hot. Rows are told apart by their own keys, so ids may be null or repeated
        (id_column is not used).
        """
        if not self.joined:
            return df.withColumn(out, F.filter(F.col(keys), lambda k: self.has(k)))
        own = df.select(F.col(keys).alias("_own")).where(F.size("_own") > 0).distinct()
        each = own.select("_own", F.posexplode("_own").alias("at", "key")).join(self.listed, "key", "left_semi")
        kept = each.groupBy("_own").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias(out))
        return df.join(kept, df[keys] == kept["_own"], "left").drop(kept["_own"]).withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def longest(keys: Column) -> Column:
    """The longest key; of equal lengths the last in byte order; null if there is none."""
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]


def judge_urls(pages: DataFrame, rules=RULES, listed_hosts: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Adds host, path, rule and verdict to each page, by the longest rule that fits, else by the listed hosts.

    rules: (action, host, path) with action block or allow; if one key has both, allow holds.
    listed_hosts: column key, hosts that are blocked with all their subdomains where no rule fits.
    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Existing
    columns named host, path, rule or verdict are replaced; others stay.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    base = pages.withColumns({"host": host_of(F.col(url_column)), "path": path_of(F.col(url_column))})
    keyed = base.withColumns({"_rule_keys": rule_keys(F.col("host"), F.col("path"), lengths), "_host_keys": host_keys(F.col("host"))})
    universe = keyed.select(F.explode("_rule_keys").alias("key"))
    hosts = keyed.select(F.explode("_host_keys").alias("key"))
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    out = keyed
    for action in ("block", "allow"):
        cascade = Cascade(spark, table([h.translate(str.maketrans(UPPER, LOWERED)) + p for a, h, p in rules if a == action]), universe, max_filter_bytes)
        out = cascade.listed_of(out, "_rule_keys", f"_{action}").withColumn(f"_{action}", longest(F.col(f"_{action}")))
    cascade = Cascade(spark, listed_hosts if listed_hosts is not None else table([]), hosts, max_filter_bytes)
    out = cascade.listed_of(out, "_host_keys", "_listed")
    allow_wins = F.col("_allow").isNotNull() & (F.col("_block").isNull() | (F.length("_allow") > F.length("_block")) | ((F.length("_allow") == F.length("_block")) & (F.col("_allow") >= F.col("_block"))))
    out = out.withColumn("rule", F.when(allow_wins, F.col("_allow")).otherwise(F.col("_block")))
    verdict = F.when(allow_wins, "allow").when(F.col("_block").isNotNull(), "block").when(F.size("_listed") > 0, "block").otherwise("allow")
    return out.withColumn("verdict", verdict).drop("_rule_keys", "_host_keys", "_block", "_allow", "_listed")


def hosts_with_labels(pages: DataFrame, labels=LISTED_LABELS, url_column: str = "url") -> DataFrame:
    """The list of hosts to block: those of the pages that have one of the labels."""
    host = host_of(F.col(url_column))
    found = F.arrays_overlap(F.split(host, "\\."), F.array(*[F.lit(x) for x in labels]))
    return pages.select(host.alias("key"), found.alias("found")).where("found").select("key").distinct()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, hosts_with_labels(pages)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(action, rhost, rpath)),
m AS (
  SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.action, CASE WHEN list_has_any(string_split(host, '.'), ['casino-win', 'spam-farm', 'cheap-pills', 'free-bets', 'adult-x', 'ads-track']) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
