"""Prefix and edit-distance search of names through an index that any number of queries join.

A word is filed under its prefixes, and, for each number of edits that queries of about its length
may make, under its pieces, one more than the edits: a query word within so many edits has one of the
pieces unharmed, moved by no more places. So both searches are joins on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a prefix that words are filed under; longer query words are compared with what their beginning finds.
PREFIX = 8
#: Edits allowed, as a share of a query word's length.
SHARE = 0.2


def words(name: Column) -> Column:
    """The different words of a name, lower-case letters and digits of the Latin alphabet."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: w != ""))


def edits_of(length: Column, share: float) -> Column:
    return F.round(length * F.lit(share)).cast("int")


def piece(word_length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of the i-th of ``edits`` + 1 pieces of a word; the last ones are longer by what is left over."""
    base = F.floor(word_length / (edits + 1)).cast("int")
    short = edits + 1 - word_length % (edits + 1)
    return (i * base + F.greatest(F.lit(0), i - short)).cast("int"), (base + (i >= short).cast("int")).cast("int")


def piece_key(word_length: Column, edits: Column, i: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("e"), word_length, edits, i, text)


def name_index(names: DataFrame, key: str = "player_id", name: str = "display_name", share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(entries, postings): (entry, word) of all different words, and (word, ``key``, ``name``) of all names.

    Names without a word, or null, are in neither. ``share`` must be that of the searches.
    """
    postings = names.select(F.explode(words(F.col(name))).alias("word"), key, name)
    own = postings.select("word").distinct().withColumn("n", F.length("word"))
    prefixes = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(PREFIX))), lambda i: F.concat(F.lit("p:"), F.left("word", i)))).alias("entry"), "word")
    # the edits that words of lengths near this one may make
    near = F.sequence(F.greatest(F.lit(1), F.floor(F.col("n") / (1 + share)).cast("int") - 1), (F.ceil(F.col("n") / (1 - share)) + 1).cast("int"))
    reach = F.filter(near, lambda m: F.abs(m - F.col("n")) <= edits_of(m, share))
    edits = own.select("word", "n", F.explode(F.array_distinct(F.transform(reach, lambda m: edits_of(m, share)))).alias("k")).where("k > 0")
    parts = edits.select("word", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, size = piece(F.col("n"), F.col("k"), F.col("i"))
    pieces = parts.select(piece_key(F.col("n"), F.col("k"), F.col("i"), F.substring("word", start + 1, size)).alias("entry"), "word")
    return prefixes.union(pieces), postings


def search_names(entries: DataFrame, postings: DataFrame, queries: DataFrame, share: float = SHARE) -> DataFrame:
    """Names that have, for every word of a query, a word that begins with it or lies within a fifth of its length in edits.

    ``queries`` has query_id and query. Returns query_id and the postings' columns but the word, and
    edits, their sum over the query's words, each with its nearest word; a prefix costs none. Words
    of queries meet only words filed under an equal entry, and both sides are different words.
    Queries without a word, or null, find nothing.
    """
    own = [c for c in postings.columns if c != "word"]
    asks = queries.select("query_id", F.explode(words(F.col("query"))).alias("ask"))
    need = asks.groupBy("query_id").agg(F.count("*").alias("need"))
    told = asks.select("ask").distinct().withColumn("m", F.length("ask")).withColumn("k", edits_of(F.col("m"), share))
    begins = told.select("ask", "k", F.concat(F.lit("p:"), F.left("ask", F.least("m", F.lit(PREFIX)))).alias("entry"))
    spread = told.where("k > 0").select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - F.col("k")), F.col("m") + F.col("k"))).alias("n"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select("*", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    start, size = piece(F.col("n"), F.col("k"), F.col("i"))
    spread = spread.withColumn("at", start + F.col("shift")).withColumn("size", size).where("at >= 0 AND at + size <= m")
    pieces = spread.select("ask", "k", piece_key(F.col("n"), F.col("k"), F.col("i"), F.substring("ask", F.col("at") + 1, F.col("size"))).alias("entry"))
    met = begins.union(pieces).distinct().join(entries, "entry").select("ask", "k", "word").distinct()
    edits = F.when(F.col("word").startswith(F.col("ask")), 0).otherwise(F.levenshtein("ask", "word"))
    hits = met.withColumn("edits", edits).where(F.col("edits") <= F.when(F.col("word").startswith(F.col("ask")), 0).otherwise(F.col("k")))
    found = asks.join(hits.select("ask", "word", "edits"), "ask").join(postings, "word")
    best = found.groupBy("query_id", *own, "ask").agg(F.min("edits").alias("edits"))
    whole = best.groupBy("query_id", *own).agg(F.count("*").alias("met"), F.sum("edits").alias("edits"))
    return whole.join(need, "query_id").where("met = need").select("query_id", *own, "edits")
