"""Quality rules with host-level verdicts (operator 6), as DataFrame expressions only.

Every document gets its counts and its failed rules from one pass over the
text. Failures are summed by host; a beta prior fitted to all hosts by moments
shrinks each host's failure rate, so that a host with few documents stays near
the corpus mean. A host whose shrunk rate passes ``host_limit`` is rejected,
and its verdict goes back to its documents: there, a document that fails any
rule is dropped; elsewhere only base failures are.

Defined results: a null or empty text has no words and fails the base rule; a
null host is a host of its own; an empty table gives no rows; rows with a null
or repeated id, and repeated rows, are judged one by one; a rate equal to the
limit does not reject; a very long text is taken whole, with one hash a word and
a window; other columns, whatever their names, are ignored. Repeated windows are
compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import WORD, content_hash, covered_words, matches, text_or_empty, without
from tallyforge.llm.scratch import Scratch

REPEAT_WORDS = 5
#: With at most this many distinct repeated windows a scan finds their places; with more, a sort does. Same result.
FEW = 24


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_word_chars: float = 2.0
    max_word_chars: float = 15.0
    host_limit: float = 0.5


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, content hash and the counts of every whole text."""
    step = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
        content_hash(text_col, host_col).alias("content_hash"),
        text_or_empty(text_col).alias("_text"),
    )
    bare = F.col("_text")
    for blank in " \n\t\r\x0b\x0c":
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    step = step.select(
        "_id",
        "_host",
        "content_hash",
        F.transform(matches(F.col("_text"), WORD), lambda w: F.xxhash64(w)).alias("_hashes"),
        F.length(bare).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    h = F.col("_hashes")
    step = step.select(
        "_id",
        "_host",
        "content_hash",
        "word_chars",
        "n_symbols",
        F.size("_hashes").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - REPEAT_WORDS + 1, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, REPEAT_WORDS)]),
        ).alias("_windows"),
    )
    w = F.col("_windows")
    step = step.withColumn("_sorted", F.when(F.size(w) > F.size(F.array_distinct(w)), F.sort_array(w)))
    again = F.transform("_sorted", lambda x, i: F.when(x == F.get("_sorted", i - 1), x))
    step = step.withColumn("_twice", F.array_distinct(F.filter(again, lambda x: x.isNotNull()))).drop("_sorted")
    few = F.size("_twice") <= FEW
    step = step.withColumn(
        "_ordered",
        F.when(~few, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))),
    )
    step = step.withColumn(
        "_repeated",
        F.when(few, F.filter(F.transform(w, lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull()))
        .otherwise(_repeated_positions(F.col("_ordered"))),
    )
    return step.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        "content_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered_words(F.col("_repeated"), REPEAT_WORDS), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _repeated_positions(ordered: Column) -> Column:
    """Sorted positions of windows that occur more than once; ``ordered`` holds (window, position), sorted.

    ``ordered`` must be a column, not an expression: it is read once for each element.
    """
    marked = F.transform(
        ordered,
        lambda x, j: F.when(
            (x["w"] == F.get(ordered, j - 1)["w"]) | (x["w"] == F.get(ordered, j + 1)["w"]), x["i"]
        ),
    )
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def base_failed(rules: Rules) -> Column:
    n = F.col("n_words")
    return (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)


def soft_failed(rules: Rules) -> Column:
    n = F.col("n_words")
    return (
        (100 * F.col("n_symbols") > rules.max_symbol_percent * n)
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
        | (F.col("word_chars") < rules.min_word_chars * n)
        | (F.col("word_chars") > rules.max_word_chars * n)
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk by an empirical beta prior.

    The prior's mean is the pooled rate and its strength is matched to the
    spread between hosts beyond what sampling explains. Two numbers describe
    it, so they pass through the driver; hosts themselves do not.
    """
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    totals = hosts.agg(
        F.count("*").alias("k"),
        F.sum("host_docs").alias("n"),
        F.sum("host_failures").alias("x"),
        F.sum(F.col("host_docs") * rate * rate).alias("sq"),
    ).first()
    alpha, beta = beta_prior(totals["k"], totals["n"] or 0, totals["x"] or 0, totals["sq"] or 0.0)
    return hosts.withColumn("host_rate", (F.col("host_failures") + alpha) / (F.col("host_docs") + alpha + beta))


def beta_prior(k: int, n: int, x: int, sq: float, most: float = 1000.0) -> tuple[float, float]:
    """(alpha, beta) by moments from k hosts, n documents, x failures and sum(n_i * rate_i**2)."""
    if not n:
        return 1.0, 1.0
    mean = (x + 0.5) / (n + 1)
    per_host = n / k
    spread = max(sq / n - (x / n) ** 2, 0.0)
    between = spread - mean * (1 - mean) / per_host
    strength = most if between <= 0 else min(max(mean * (1 - mean) / between - 1, 1.0), most)
    return mean * strength, (1 - mean) * strength


def quality_verdicts(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Counts, failed rules, host rate and verdict for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    judged = text_counts(docs, id_col, text_col, host_col).withColumns(
        {"base_failed": base_failed(rules), "soft_failed": soft_failed(rules)}
    )
    judged = scratch.save(judged, "counts")
    # Written, so that Spark knows its size: a small table is broadcast, and beside a large one a hot host is split.
    hosts = scratch.save(host_rates(judged), "hosts")
    return judged.join(hosts, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~((F.col("host_rate") > rules.host_limit) & F.col("soft_failed"))
    )


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*CONTRACT)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns: the pipeline's first stage.

    The verdict needs a second look at each document. Rejected rows are found
    again by id and content, so repeated rows stay or go together and rows that
    share an id, null included, are judged by their own texts. Null and empty
    texts have no words and go; a null source is the host of empty name; very
    long texts are judged whole; no rows give none; other columns are kept,
    whatever their names.
    """
    rejected = quality_verdicts(docs, rules).where(~F.col("kept"))
    return without(docs, rejected, "doc_id", content_hash("text", "source"))


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5),
wins AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS win FROM spots),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS k FROM wins) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN rep USING (r)),
judged AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
failed AS (
  SELECT *, 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * len(lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed FROM judged),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed OR soft_failed))::DOUBLE AS x FROM failed GROUP BY host),
totals AS (SELECT count(*) AS k, sum(n) AS n, sum(x) AS x, sum(n * (x / n) * (x / n)) AS sq FROM hosts),
moments AS (
  SELECT (x + 0.5) / (n + 1) AS mean, greatest(sq / n - (x / n) * (x / n), 0) AS spread, n / k AS per FROM totals),
prior AS (
  SELECT mean, CASE WHEN spread - mean * (1 - mean) / per <= 0 THEN 1000.0
    ELSE least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) / per) - 1, 1.0), 1000.0) END AS strength FROM moments),
rates AS (SELECT host, (x + mean * strength) / (n + strength) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rate > 0.5 AND soft_failed) AS kept
FROM failed JOIN rates USING (host)
"""
