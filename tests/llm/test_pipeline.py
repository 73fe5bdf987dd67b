"""The pipeline's stages, each against brute force on the rows it was given."""

import corpus_pipeline
from tallyforge.llm import registry
from tests.llm.test_natives import brute_counts, brute_hits, brute_secrets
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check_sequences

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "decontamination", "secret scans", "best-fit packing"]
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality rules":
            for d, r in rows.items():
                n, _, _, _, rep = brute_counts(r.text)
                if n < 10 or 100 * rep > 20 * n:
                    assert d not in after
            assert len(after) > 0.5 * len(rows)
        elif name == "near dedup":
            assert set(after) == {d for d, _, c, _ in brute([(d, r.text) for d, r in rows.items()], 5) if d == c}
        elif name == "decontamination":
            assert set(after) == {d for d, r in rows.items() if not brute_hits(r.text, items)[4]}
        else:
            assert set(after) == set(rows)
            for d, r in rows.items():
                assert (after[d].text == r.text) == (brute_secrets(r.text or "") == "")
                assert after[d].n_chars == len(after[d].text) or after[d].n_chars == r.n_chars
        docs, rows = spark.createDataFrame(out.collect(), out.schema), after
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(rows)
    check_sequences(pieces)


WORDS = "every stage keeps the whole text of this plain and clean document about rivers number"
SECRET = "the deploy script of our small team reads api_key = abcdef123456 from its own settings file"
CLASHES = ["_spans", "_rules", "_cand", "_doc", "_own", "_hash", "_gone", "_id", "id", "n", "doc", "content", "host", "kept", "key", "piece", "length", "n_words", "contaminated", "represents"]


def test_edge_rows_in_every_stage(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    place = schema.names.index
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 15").orderBy("item_id").first().text
    long = " ".join(f"w{i * 7919 % 60_013}" for i in range(60_000))

    def row(d, text, source="a.com"):
        out = [None] * len(schema)
        out[place("doc_id")], out[place("text")], out[place("source")] = d, text, source
        return tuple(out)

    rows = [
        row(None, None, None), row(1, None), row(2, ""), row(3, f"{WORDS} three", None), row(3, f"{WORDS} three", None),
        row(4, f"{WORDS} three"), row(5, f"{SECRET} now"), row(5, " ".join(f"x{i}" for i in range(40))), row(6, long), row(7, long),
        row(8, passage), row(None, " ".join(f"y{i}" for i in range(40))),
    ]
    docs = spark.createDataFrame(rows, schema).coalesce(2)
    for name in CLASHES:
        docs = docs.withColumn(name, docs["doc_id"].cast("string"))
    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.select("doc_id", "text").collect() if r.text)
    columns, given = docs.columns, texts(docs)
    filters, packing = [f for _, f in corpus_pipeline.STAGES[:4]], corpus_pipeline.STAGES[4][1]
    outs = [stage(spark, docs, SF) for stage in filters]
    assert all(out.columns == columns for out in outs)
    quality, near, decontaminated, redacted = outs

    assert texts(quality) == given
    assert texts(near) == [g for k, g in enumerate(given) if g not in given[:k] and g[0] not in (4, 7)]
    assert texts(decontaminated) == [g for g in given if g[0] != 8]
    assert texts(redacted) == [(d, t.replace("api_key = abcdef123456", "[assign]")) for d, t in given]
    assert redacted.where("text IS NULL").count() == 2
    assert packing(spark, docs, SF).where("piece = 0").count() == len(rows)
    for stage in [*filters, packing]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
