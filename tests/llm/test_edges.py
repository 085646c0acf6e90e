"""Empty tables, very long texts, clashing columns and ties for the operators and stages that had no such test."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest

from twinroute.llm import html_extraction, language_id, maxent_lm, packing, ranked_search, simhash_dedup, structure_repair, substring_dedup, tables, toxicity, url_filters

DOC = "doc_id long, text string"
LONG = "long words in a very long text " * 40_000


def docs(spark, *rows):
    return spark.createDataFrame([(1, "un texte court en cette langue"), (2, "a short text in that language"), *rows], DOC)


def clashing(df, *names):
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def test_packing_of_nothing_and_of_a_long_text(spark):
    cut = tables.materialise(packing.pieces(docs(spark).limit(0)))
    assert packing.pack(cut).count() == 0
    whole = packing.pack(tables.materialise(packing.pieces(docs(spark, (3, LONG))))).where("doc_id = 3").collect()
    ids = packing.encoder(packing.VOCABULARY).ids(LONG)
    assert sum(r["length"] for r in whole) == len(ids) + 1 and max(r["length"] for r in whole) == 1024
    assert sorted(r["start"] for r in whole)[0] == 0 and len({r["sequence_id"] for r in whole if r["length"] == 1024}) == len(whole) - (min(r["length"] for r in whole) < 1024)


def test_language_of_nothing_and_of_a_long_text(spark):
    from pyspark.sql import functions as F

    labelled = docs(spark).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").otherwise("en"))
    model = language_id.train(labelled)
    asked = docs(spark, (3, LONG), (4, None), (5, "123 !")).withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()}
    assert got[1][0] == "fr" and got[2][0] == "en" and got[3][0] in ("fr", "en") and got[4][0] == got[5][0] == "und" and all(0 <= s <= 1 for _, s in got.values())
    # the least code length decides: held against each tree's own lengths
    texts = ["a short text in that language", "un texte court en cette langue", LONG[:5000]]
    bits = model.code_lengths(pa.array(texts))
    names = model.langs
    for t, row in zip(texts, bits):
        one = spark.createDataFrame([(9, t, True)], "doc_id long, text string, held_out boolean")
        assert language_id.predict(one, model).first()["lang_pred"] == names[int(row.argmin())]
    assert language_id.predict(asked.limit(0), model).count() == 0


def test_fingerprints_of_nothing_ties_and_a_long_text(spark):
    assert simhash_dedup.groups(docs(spark).limit(0)).count() == 0
    rows = simhash_dedup.groups(docs(spark, (9, LONG), (3, LONG), (7, LONG + " end"))).collect()
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[3] == of[9] == 3 and of[1] == 1 and of[2] == 2


def test_toxicity_of_nothing_and_of_a_long_text(spark, sf):
    from pyspark.sql import functions as F

    model = toxicity.train(tables.text_and_id(tables.table(spark, sf, "documents")), tables.table(spark, sf, "labels"))
    asked = docs(spark, (3, LONG), (4, None), (5, "")).withColumn("held_out", F.lit(False))
    got = toxicity.score(asked, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(asked.limit(0), model).count() == 0
    # brute force of the scores: what the task gives is what the model gives text by text
    alone = {r["doc_id"]: r["score"] for r in got}
    for r in asked.collect():
        assert alone[r["doc_id"]] == pytest.approx(float(model.scores(pa.array([r["text"]], pa.string()))[0]), abs=1e-12)


def test_filters_with_clashing_columns(spark, sf):
    pages = tables.table(spark, sf, "pages")
    plain = [tuple(r) for r in url_filters.judge(url_filters.captures_of(pages), url_filters.validity(url_filters.entries_of(pages))).collect()]
    more = clashing(pages, "key", "host", "since", "until", "entry", "bin", "salt", "fetched", "list")
    again = [tuple(r) for r in url_filters.judge(url_filters.captures_of(more), url_filters.validity(url_filters.entries_of(more))).collect()]
    assert sorted(plain, key=str) == sorted(again, key=str) and plain
    none = pages.limit(0)
    assert url_filters.judge(url_filters.captures_of(none), url_filters.validity(url_filters.entries_of(none))).count() == 0


def test_long_texts_of_the_other_operators(spark):
    kept = substring_dedup.rewrite(docs(spark, (3, LONG), (4, LONG)))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3}
    train = docs(spark, (3, LONG))
    model, counts = maxent_lm.train(train)
    scored = maxent_lm.score(clashing(train, "n").drop("n").selectExpr("doc_id", "text", "false AS held_out"), model, counts).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in scored}[3] == 280_001
    items = spark.createDataFrame([(1, "very LONG"), (2, "court")], "item_id long, text string")
    best = {(r["item_id"], r["rank"]): r["doc_id"] for r in ranked_search.search(docs(spark, (3, LONG)), items).collect()}
    assert best == {(1, 1): 3, (2, 1): 1}
    turn = spark.createDataFrame([(1, 0, "user", LONG + "?"), (1, 1, "assistant", "yes.")], "conv_id long, turn long, role string, text string")
    assert structure_repair.digests(turn).first()["repaired_sha256"] == hashlib.sha256(f"user:{LONG}?\nassistant:yes.".encode()).hexdigest()
    page = f"<article><p>{LONG}</p></article>"
    assert html_extraction.main_texts([page], html_extraction.trained()) == [LONG.strip()]


def test_pipeline_of_nothing_and_with_clashing_columns(spark, sf):
    import corpus_pipeline
    from pyspark.sql import functions as F

    whole = spark.read.parquet(f"{sf}/documents.parquet")
    empty = whole.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = tables.materialise(stage(spark, empty, sf))
        assert empty.columns == whole.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
    # two stages by which rows go: extra columns whose names the stages use stay as they are
    some = clashing(whole.limit(30), "key", "row", "first", "item", "kept", "start", "_gone")
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        out = stage(spark, some, sf)
        assert out.columns == some.columns and out.where(F.col("key") != "x").count() == 0
