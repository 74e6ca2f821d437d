"""A corpus pipeline of five stages: from documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointline.llm.batches import written
from pointline.llm.bpe import encode_documents
from pointline.llm.linededup import drop_recurring_lines
from pointline.llm.mixing import emit_copies, mix_sources
from pointline.llm.quality import fit_quality, score_quality
from pointline.llm.queries import table, vocabulary
from pointline.llm.shingles import jaccard_classes

#: Documents with a lower probability of good quality are rejected.
LEAST_SCORE = 0.3
#: Lines of more words go where they recur in two texts, shorter ones from five on.
LONG_WORDS = 50

#: Bytes of texts that Spark hands to a Python worker at once; a longer text goes alone.
BATCH_BYTES = "8m"

#: SQL can't express the learned scores, fingerprints and merges; tests compare the stages with brute force.
ORACLE_SQL = None


#: Columns of documents that the stages read.
NEEDED = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but NEEDED renamed, so that no name of theirs clashes with what an operator adds."""
    return docs.toDF(*[c if c in NEEDED else f"__own_{k}" for k, c in enumerate(docs.columns)])


def batched(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; Spark's 64 MB stand in the JVM and in the worker, for each core."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among ``docs``.

    Null and empty texts have the score of no words, all alike, and go or stay by it. Rows with a null
    id and repeated rows are scored like others. No rows give no rows; without labels of both
    classes nothing tells documents apart, and all stay or go by the share of label 1. Further columns
    pass through, whatever they are called.
    """
    batched(spark)
    own = shielded(docs)
    model = fit_quality(own, table(spark, sf_dir, "labels"))
    return score_quality(own, model, score_col="__score").where(F.col("__score") >= LEAST_SCORE).select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across texts, long lines from two texts on; n_chars follows.

    Near copies of a document count as one text and keep their lines alike, for near_dedup to find them.
    Null and empty texts pass through; rows with a null id count as one document; repeated rows are
    treated alike. No rows give no rows. Further columns pass through, whatever they are called.
    """
    batched(spark)
    own = shielded(docs)
    classes = jaccard_classes(own).select("text_hash", "class").distinct()
    several = classes.groupBy("class").count().where("count > 1").select("class")
    same = written(classes.join(several, "class"), "near-texts")
    out = drop_recurring_lines(own, long_words=LONG_WORDS, variants=True, same=same)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (Jaccard of five-word shingles 0.8 or more): of that with the smallest id.

    Rows are told apart by id and text, so rows without an id, or with the id of another text, stand for themselves.
    Null texts and texts without words are one class; rows that repeat an id and text come down to
    one. No rows give no rows. Further columns are those of the row that stays, whatever they are called.
    """
    batched(spark)
    plain = shielded(docs)
    rows = jaccard_classes(plain).groupBy("class", "id", "text_hash").agg(F.count("*").alias("n"))
    rows = written(rows.withColumn("rank", F.struct(F.col("id").isNull(), "id", "text_hash")), "near-duplicates")
    first = rows.groupBy("class").agg(F.min("rank").alias("first"))
    told = written(rows.join(first, "class").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "n", (F.col("rank") == F.col("first")).alias("kept")).where("NOT kept OR n > 1"), "near-duplicates")
    # what goes is the smaller part; its written size tells Spark how to join
    own = plain.withColumn("__text", F.xxhash64("text"))
    out = own.join(told.where("NOT kept").select("__id", "__hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_anti")
    # rows that repeat a kept id and text come down to one
    out = out.dropDuplicates(["doc_id", "__text"]) if told.where("kept").limit(1).count() else out
    return out.select(*plain.columns).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words, but are taken by their source's rate like others; a null
    source is one of its own. Repeated rows share their id's draw and are taken as often each. No rows
    give no rows. Further columns pass through, whatever they are called.
    """
    own = shielded(docs)
    return emit_copies(mix_sources(own), own.columns).toDF(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and input_ids of every emitted document.

    Null texts count as empty and have no ids; null ids and repeated rows pass through; further
    columns aren't carried. No rows give no rows.
    """
    batched(spark)
    return encode_documents(shielded(docs), vocabulary(), with_ids=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
