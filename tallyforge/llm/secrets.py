"""Secret scans by a trigram inverted index (operator 1), as DataFrame expressions only.

Each rule is a regular expression. ``trigrams.clauses`` turns it into a Boolean
query; postings (trigram, document) are kept for the trigrams that the queries
name, and a rule's candidates are the documents in the intersection of one of
its clauses' postings. Only candidates are searched with the rule's expression;
a rule without mandatory trigrams searches every text.

Matches are leftmost and non-overlapping per rule. Their places follow from the
pieces between them: ``split`` gives the pieces, ``regexp_extract_all`` the
matches, both by the same matcher.

Defined results: a null text is an empty one; a text without matches has no
spans and the digest of an empty string; rows are found again by id and content,
so rows with a null or a repeated id are searched like any other; spans that
begin together go by their rule's place; of overlapping ones the first names the
replacement; places are summed up and texts put together in blocks of ``BLOCK``
matches, so a very long text takes time in proportion; an empty table gives no
rows; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.columns import content_hash, literal_rows, matches, named, scanned, text_or_empty
from tallyforge.llm.scratch import Scratch
from tallyforge.llm.trigrams import clauses


#: Matches of a text that one running sum goes over.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


#: Fixed values of the contract come first; a look-behind spares the hex rule runs that are too short.
RULES = [
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        min_chars=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=20, base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", base=True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def postings(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """(trigram, _id, _hash): the inverted index over the trigrams that the rules name, by id and content."""
    named_ = sorted({t for r in rules for c in clauses(r.pattern) or [] for t in c})
    lowered = docs.select(
        F.col(id_col).alias("_id"), content_hash(text_col).alias("_hash"), F.lower(text_or_empty(text_col)).alias("_low")
    )
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in named_]))
    return lowered.select("_id", "_hash", F.explode(present).alias("trigram"))


def candidates(spark: SparkSession, index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_id, _hash, _rules): for each document the rules whose query its postings satisfy."""
    wanted = [
        (r.kind, k, t, len(c)) for r in rules for k, c in enumerate(clauses(r.pattern) or []) for t in sorted(c)
    ]
    # The clauses are as many as the rules make them, whatever the corpus.
    clause = literal_rows(spark, wanted, "kind string, clause int, trigram string, needed int")
    return (
        index.distinct()
        .join(F.broadcast(clause), "trigram")
        .groupBy("_id", "_hash", "kind", "clause", "needed")
        .count()
        .where(F.col("count") == F.col("needed"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set("kind").alias("_rules"))
    )


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct(start, rank, end)> of a rule's accepted matches; code points, end exclusive."""
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    found = F.transform(matches(text, rule.pattern), lambda m: F.length(m))
    kept = found if rule.group == 0 else F.transform(matches(text, rule.pattern, rule.group), lambda m: F.length(m))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def after(at: Column, r: Column) -> Column:
        return at + r["piece"] + F.coalesce(r["found"], F.lit(0))

    def placed(block: Column, at: Column, _: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda a, r: F.struct(
                after(a["at"], r).alias("at"),
                F.when(
                    r["kept"] >= rule.min_chars,
                    F.concat(
                        a["out"],
                        F.array(
                            F.struct(
                                (a["at"] + r["piece"]).alias("start"),
                                F.lit(rank).alias("rank"),
                                (a["at"] + r["piece"] + r["found"]).alias("end"),
                            )
                        ),
                    ),
                )
                .otherwise(a["out"])
                .alias("out"),
            ),
            lambda a: a["out"],
        )

    rows = F.arrays_zip(pieces.alias("piece"), found.alias("found"), kept.alias("kept"))
    return scanned(
        rows, BLOCK, F.lit(0), lambda b: F.aggregate(b, F.lit(0), after), lambda at, n: at + n,
        lambda out, _: F.flatten(out), placed,
    )


def find_secrets(
    docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with ``_spans``: array<struct(start, rank, end)>, sorted; rank is the rule's place in ``rules``."""
    return _searched(docs, rules, id_col, text_col).select("_doc.*", "_spans")


def _searched(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """(_doc, _spans): each row of docs as one struct, so that no name clashes, and its spans."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    index = scratch.save(postings(docs, rules, id_col, text_col), "postings")
    chosen = candidates(spark, index, rules)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), content_hash(text_col).alias("_own"))
    same = whole["_doc"][id_col].eqNullSafe(chosen["_id"]) & (whole["_own"] == chosen["_hash"])
    joined = whole.join(chosen, same, "left")
    text = F.coalesce(F.col("_doc")[text_col], F.lit(""))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = [
        F.when(F.array_contains("_rules", r.kind), spans(text, r, k)).otherwise(empty)
        if clauses(r.pattern)
        else spans(text, r, k)
        for k, r in enumerate(rules)
    ]
    return joined.select("_doc", F.sort_array(F.flatten(F.array(*each))).alias("_spans"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def span_list(spans_col: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans_col, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "_spans")
    kinds = [r.kind for r in RULES]
    counts = [
        F.size(F.filter("_spans", _of_rank(k))).cast("long").alias(f"n_{r.kind}")
        for k, r in enumerate(RULES)
        if r.base
    ]
    base = F.filter("_spans", lambda s: s["rank"] < sum(r.base for r in RULES))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base, kinds), 256).alias("base_sha256"),
        span_list(F.col("_spans"), kinds).alias("spans"),
    )


def redact(
    docs: DataFrame,
    rules: list[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_col: str = "n_chars",
) -> DataFrame:
    """docs with every secret replaced by ``[kind]``; a text without one stays as it is, null included.

    Overlapping spans are replaced as one, under the first one's kind. A changed
    text's ``count_col``, if there is one, becomes its new length. Every row
    stays, rows with a null or repeated id and repeated rows too; very long texts
    are searched whole; no rows give none; other columns are kept, whatever their
    names.
    """
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    found = _searched(docs, rules, id_col, text_col)
    text = F.col("_doc")[text_col]

    def pieces(block: Column, before: Column, after: Column) -> Column:
        # The block's own stretch of the text, so that no piece is looked for from the text's beginning.
        def cut(part: Column) -> Column:
            return F.aggregate(
                block,
                F.struct(before.alias("at"), F.array().cast("array<string>").alias("out")),
                lambda a, s: F.struct(
                    F.greatest(a["at"], s["end"]).alias("at"),
                    F.when(
                        s["start"] >= a["at"],
                        F.concat(
                            a["out"],
                            F.array(F.substring(part, a["at"] - before + 1, s["start"] - a["at"]), F.get(kinds, s["rank"])),
                        ),
                    )
                    .otherwise(a["out"])
                    .alias("out"),
                ),
                lambda a: a["out"],
            )

        return named(F.substring(text, before + 1, after - before), cut)

    cut = scanned(
        F.col("_spans"), BLOCK, F.lit(0), lambda b: F.array_max(F.transform(b, lambda s: s["end"])), F.greatest,
        lambda out, at: F.concat(F.array_join(F.flatten(out), ""), F.substring(text, at + 1, F.length(text))), pieces,
    )
    changed = F.size("_spans") > 0
    found = found.select("_doc", F.when(changed, cut).otherwise(text).alias("_text"), changed.alias("_changed"))
    out = []
    for c in docs.columns:
        column = F.col("_doc")[c]
        if c == text_col:
            column = F.col("_text")
        elif c == count_col:
            counted = F.length("_text").cast(docs.schema[c].dataType)
            column = F.when(F.col("_changed"), counted).otherwise(column)
        out.append(column.alias(c))
    return found.select(*out)


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds(kind, rank, pat, grp, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('forge', 3, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0),
  ('chat', 4, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0),
  ('pem', 5, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0),
  ('jwt', 6, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0)),
found AS (
  SELECT r, 0 AS rank, string_split_regex(text, (SELECT pat FROM kinds WHERE rank = 0)) AS p,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM docs
  UNION ALL SELECT r, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT r, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM docs
  UNION ALL SELECT r, k.rank, string_split_regex(text, k.pat), regexp_extract_all(text, k.pat), regexp_extract_all(text, k.pat) FROM docs, kinds k WHERE k.rank > 2),
each AS (SELECT r, rank, unnest(range(1, len(m) + 1)) AS i, p, m, g FROM found WHERE len(m) > 0),
lens AS (SELECT r, rank, i, length(p[i]) AS pl, length(m[i]) AS ml, length(g[i]) AS gl FROM each),
placed AS (
  SELECT r, rank, gl, ml, sum(pl) OVER w + sum(ml) OVER w - ml AS s FROM lens
  WINDOW w AS (PARTITION BY r, rank ORDER BY i ROWS UNBOUNDED PRECEDING)),
good AS (
  SELECT r, k.rank, s, kind, kind || ':' || s::BIGINT || ':' || (s + ml)::BIGINT AS span
  FROM placed JOIN kinds k USING (rank) WHERE gl >= least)
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
  count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM docs LEFT JOIN good USING (r) GROUP BY r, doc_id
"""
