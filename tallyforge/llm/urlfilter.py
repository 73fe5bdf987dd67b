"""URL verdicts from a Bloom filter cascade (operator 4), as DataFrame expressions only.

A listed key is a host followed by a path prefix. The keys a URL can match are
every suffix of its host at a dot, followed by every prefix of its path that has
the length of a listed path. The cascade's first level encodes the listed keys;
the second encodes the keys of the whole corpus that the first wrongly passes;
the third encodes the listed keys that the second wrongly passes; and so on
until a level passes nothing wrongly. For every key of the corpus the answer is
then exact, and it is a few bit tests on constants: no join.

A level's bits are a constant of the plan. A level is sized for the keys it must
keep out: the first for the whole corpus, so that what it wrongly passes is
about as many keys as are listed, however large the corpus; each later one for
the keys before it. A list of more keys than ``MAX_BITS`` allows for is dealt
into shards by a hash of the key; a pass over the URLs looks up one shard's keys
in that shard's cascade, and the passes' answers are put together.

Defined results: a null URL or one without ``://`` has an empty host and path
and gets the default verdict; of rules of equal length the last in string order
wins, and a key listed under both verdicts is blocked; an empty table gives no
rows; repeated rows, null ids and ids of any type are judged row by row; a very
long URL has as many keys as its host has labels times the rules' path lengths;
null listed keys are ignored; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.columns import LOWER, UPPER, bit_is_set, literal_rows, long_array
from tallyforge.llm.scratch import Scratch

#: Bits that a shard's first level may take, at about ``BITS_EACH`` a key.
MAX_BITS = 1 << 23
BITS_EACH = 64
MOST_HASHES = 40

#: Fixed values of the contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Hosts that are blocked where no rule fits (a parameter of the operator).
BLOCKED_HOSTS = ["cheap-pills.example.com", "spam-farm.example.org"]


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every listed key that could fit: host suffix followed by path prefix."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]), lambda p: p.isNotNull()
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    seed: int
    n_hashes: int
    n_bits: int
    words: list[int]

    def passes(self, key: Column) -> Column:
        bits = long_array(self.words)
        found = F.lit(True)
        for k in range(self.n_hashes):
            found = found & bit_is_set(bits, self.n_bits, _hashed(key, self.seed, k))
        return found


def _hashed(key: Column, seed: int, k: int) -> Column:
    return F.xxhash64(key, F.lit(seed * MOST_HASHES + k))


def build_level(keys: DataFrame, seed: int, n_keys: int, n_others: int) -> Level:
    """A Bloom filter of the column ``key`` that wrongly passes about n_keys / 4 of n_others keys.

    Half of its bits are set, so a key that is not listed takes two look-ups on average.
    """
    n_hashes = min(MOST_HASHES, max(1, math.ceil(math.log2(max(1.0, n_others / n_keys)))) + 2)
    n_bits = max(64, 1 << math.ceil(math.log2(n_keys * n_hashes / math.log(2))))
    at = [_hashed(F.col("key"), seed, k).bitwiseAND(F.lit(n_bits - 1)) for k in range(n_hashes)]
    set_bits = (
        keys.select(F.explode(F.array(*at)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    )
    words = [0] * (n_bits // 64)
    for row in set_bits.collect():
        words[row["word"]] = row["bits"]
    return Level(seed, n_hashes, n_bits, words)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, scratch: Scratch, name: str) -> Cascade:
    """From the distinct listed keys and all keys of the corpus (column ``key``, repeats allowed)."""
    n = listed.count()
    if n == 0:
        return Cascade([])
    levels = [build_level(listed, 0, n, n_universe)]
    inside = listed
    # Only keys that the first level passes can ever be wrong, so only they are gathered.
    outside = scratch.save(
        universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"), name
    )
    others = n
    while True:
        seed = len(levels)
        wrong = outside if seed % 2 else inside
        for level in levels[1 + seed % 2 :: 2]:
            wrong = wrong.where(level.passes(F.col("key")))
        n = wrong.count()
        if n == 0:
            return Cascade(levels)
        levels.append(build_level(wrong, seed, n, others))
        others = n


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    blocked: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict for each row of pages.

    ``rules`` has (host, path, verdict), at most a few path lengths; ``blocked``
    has (host), hosts blocked where no rule fits. Both may be tables of any length.
    """
    scratch = Scratch(pages.sparkSession)
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    named = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"))
    named = scratch.save(named, "rules")
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    hosts = scratch.save(blocked.where(F.col("host").isNotNull()).select(F.col("host").alias("key")).distinct(), "hosts")
    urls = pages.select(
        F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    rule_keys, host_keys = url_keys(F.col("host"), F.col("path"), lengths), url_keys(F.col("host"), F.lit(""), [0])
    totals = urls.agg(F.sum(F.size(rule_keys).cast("long")).alias("r"), F.sum(F.size(host_keys).cast("long")).alias("h")).first()
    shards = max(1, -(-max(named.count(), hosts.count()) // max(1, MAX_BITS // BITS_EACH)))
    none = F.lit(None).cast("struct<n:int,k:string,blocked:boolean>")
    answer = urls.select("_id", "host", "path", none.alias("_best"), F.lit(False).alias("_listed"))
    for s in range(shards):
        own = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(shards)) == s  # noqa: B023, E731
        listed = lambda df: df.select("key").where(own(F.col("key")))
        ruled, hosted = (listed(urls.select(F.explode(k).alias("key"))) for k in (rule_keys, host_keys))
        allow = build_cascade(listed(named.where("verdict = 'allow'")), ruled, totals["r"] or 0, scratch, f"allow-{s}")
        block = build_cascade(listed(named.where("verdict = 'block'")), ruled, totals["r"] or 0, scratch, f"block-{s}")
        junk = build_cascade(listed(hosts), hosted, totals["h"] or 0, scratch, f"junk-{s}")
        mine = (lambda k: own(k)) if shards > 1 else (lambda k: F.lit(True))
        fit = lambda k: F.when(block.contains(k), True).when(allow.contains(k), False)  # noqa: B023, E731
        judged = F.transform(rule_keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"), F.when(mine(k), fit(k)).alias("blocked")))  # noqa: B023
        best = F.array_max(F.filter(judged, lambda x: x["blocked"].isNotNull()))
        answer = answer.withColumns(
            {
                "_best": F.greatest(F.col("_best"), best),
                "_listed": F.col("_listed") | F.exists(host_keys, lambda k: mine(k) & junk.contains(k)),  # noqa: B023
            }
        )
        if shards > 1:
            answer = scratch.save(answer, f"answer-{s}")
    verdict = (
        F.when(F.col("_best").isNotNull(), F.when(F.col("_best.blocked"), "block").otherwise("allow"))
        .when(F.col("_listed"), "block")
        .otherwise(default)
    )
    return answer.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.k").alias("rule"), verdict.alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = literal_rows(spark, RULES, "host string, path string, verdict string")
    blocked = literal_rows(spark, [(h,) for h in BLOCKED_HOSTS], "host string")
    return url_verdicts(pages, rules, blocked)


OP4_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
junk(jhost) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
    CASE WHEN EXISTS (SELECT 1 FROM junk WHERE host = jhost OR ends_with(host, '.' || jhost))
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""
