"""The pipeline's stages against what each must do to its own input, and the operators' SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointline.llm import queries
from test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    rows, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        if name != "bpe":
            assert after.columns == docs.columns
        rows.append((name, before.count(), after.count()))
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            kept = after.join(labels.where("quality = 1"), "doc_id").count()
            assert kept >= 0.95 * before.join(labels.where("quality = 1"), "doc_id").count()
        if name == "line_dedup":
            assert before.select("doc_id").exceptAll(after.select("doc_id")).count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "near_dedup":
            # the stage's own rule: five-word shingles at a Jaccard similarity of 0.8
            own = before.orderBy("doc_id").collect()
            label = brute_classes([r.text for r in own])
            assert sorted(r.doc_id for r in after.collect()) == sorted(own[i].doc_id for i in set(label))
        if name == "mixing":
            assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name == "bpe":
            assert after.where("size(input_ids) <> n_tokens").count() == 0
        before = after
    assert corpus_pipeline.run(spark, SF).count() == rows[-1][2]


def test_repeated_ids_come_down_to_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (3, "other words of it", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    key = lambda rows, names: sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=str)
    assert key(df.collect(), df.columns) == key(want.fetchall(), want.columns)


CLASHES = ["score", "__score", "__text", "__drop", "__id", "__hash", "line", "n_lines", "n_dropped", "size", "rate", "copies", "target", "source_size", "__n", "__own_5", "features", "n_tokens", "class"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_nulls_empties_repeats_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["first text of its own", "first text of its own", None, "", " \n ", "x" * 50_000, "word " * 50_000, "other text with more words in it"]
    rows = [(i, t, "en", None if i % 2 else "s", None) for i, t in enumerate(texts)] + [(None, "without an id", None, "s", 3), (None, None, None, None, None), (0, texts[0], "en", "s", None)]
    docs = spark.createDataFrame(rows, fields)
    wide = docs
    for k, c in enumerate(CLASHES):
        wide = wide.withColumn(c, F.lit(f"own {k}"))
    plain, got = stage(spark, docs, SF), stage(spark, wide, SF)
    if name == "bpe":
        assert plain.count() == got.count() == len(rows)
        return
    assert plain.columns == docs.columns and got.columns == wide.columns
    key = lambda df: sorted(map(str, (tuple(r)[:5] for r in df.collect())))
    assert key(plain) == key(got)
    assert all(tuple(r)[5:] == tuple(f"own {k}" for k in range(len(CLASHES))) for r in got.collect())
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "line_dedup":
        assert got.count() == len(rows)
    if name == "near_dedup":
        # ids 0 and 1 are copies, and so are null, empty and blank texts
        assert sorted((str(r.doc_id) for r in got.collect())) == ["0", "2", "5", "6", "7", "None"]
