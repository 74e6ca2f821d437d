"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: a leaf of the tree holds the lines with the same number of tokens
and the same leading tokens, tokens with digits standing for a variable field. Within a leaf a token
is a constant if it recurs at its place across texts, and a variable field otherwise; a line with
its fields generalised is its template. Lines whose template recurs across texts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import fresh, stable

#: What stands for a variable field.
FIELD = "<*>"
#: Leaves that recur are broadcast up to this number of 8-byte keys, and joined by a shuffle beyond it.
BROADCAST_LEAVES = 1_000_000


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def joined_variants(distinct: DataFrame, depth: int, wild: float) -> DataFrame:
    """(leaf, key, variant): rare lines and the nearest recurring line of their leaf that differs in at most ``wild`` of the tokens.

    Of k + 1 pieces that the tokens after ``depth`` are cut in, k differing tokens leave one equal, so
    lines meet by the pieces they share.
    """
    rows = distinct.withColumn("t", F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).withColumn("n", F.size("t"))
    rows = rows.withColumn("most", F.floor(F.col("n") * wild + 1e-9).cast("int")).where("most > 0").withColumn("common", F.col("texts") >= F.col("need"))
    rows = rows.join(rows.where("common").select("leaf").distinct(), "leaf", "left_semi")
    at = lambda i: F.lit(depth) + F.floor(i * (F.col("n") - depth) / (F.col("most") + 1)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.xxhash64(i, F.slice("t", at(i) + 1, at(i + 1) - at(i))))
    rows = stable(rows.where(F.col("n") - depth > F.col("most")).select("leaf", "key", "common", "most", "t", F.explode(piece).alias("piece")))
    common = rows.where("common").select("leaf", "piece", F.col("key").alias("variant"), F.col("t").alias("__t"))
    met = rows.where("NOT common").join(common, ["leaf", "piece"])
    differ = F.aggregate(F.zip_with("t", "__t", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    met = met.withColumn("differ", differ).where(F.col("differ") <= F.col("most"))
    return met.groupBy("leaf", "key").agg(F.min(F.struct("differ", "variant")).alias("best")).select("leaf", "key", F.col("best.variant").alias("variant"))


def line_templates(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int, depth: int, wild: float, long_words: int | None = None, long_docs: int = 2, variants: bool = False, same: DataFrame | None = None
) -> DataFrame:
    """(id, text_key, line, need, template): hashes of the lines of recurring leaves and of their templates.

    Each distinct masked line moves once with its text; all else that is shuffled are hashes.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    lines = rows.select("id", F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.withColumn("tokens", tokens_of(F.col("line"))).where("size(tokens) > 0")
    lines = lines.withColumn("leaf", F.xxhash64(F.size("tokens"), F.concat_ws(" ", masked(F.slice("tokens", 1, depth)))))
    need = F.lit(min_docs) if long_words is None else F.when(F.size("tokens") > long_words, long_docs).otherwise(min_docs)
    lines = lines.withColumn("need", need)
    leaves = stable(lines.select("leaf", "need", "text_key").distinct().groupBy("leaf").agg(F.count("*").alias("count"), F.min("need").alias("need")).where("count >= need").select("leaf"))
    small = leaves.count() <= BROADCAST_LEAVES
    kept = lines.join(F.broadcast(leaves) if small else leaves, "leaf", "left_semi")
    # a line that is mostly fields says nothing once masked, so it stands as it is
    fields = lambda c: F.size(F.filter(c, lambda t: t == FIELD)) / F.size(c)
    kept = kept.withColumn("m", masked(F.col("tokens"))).withColumn("m", F.when(fields(F.col("m")) <= wild, F.col("m")).otherwise(F.col("tokens")))
    kept = kept.withColumn("masked", F.concat_ws(" ", "m"))
    kept = kept.select("id", "text_key", F.xxhash64("line").alias("line"), "leaf", "need", "masked", F.xxhash64("masked").alias("key"))
    if same is not None:
        kept = kept.join(same.select(F.col("text_hash").alias("text_key"), "class"), "text_key", "left").withColumn("text_key", F.coalesce("class", "text_key")).drop("class")
    kept = stable(kept)
    texts = kept.select("leaf", "key", "need", "text_key").distinct().groupBy("leaf", "key").agg(F.count("*").alias("texts"), F.min("need").alias("need"))
    distinct = stable(kept.groupBy("leaf", "key").agg(F.first("masked").alias("masked")).join(texts, ["leaf", "key"]))
    token = F.posexplode(F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).alias("pos", "token")
    places = distinct.select("leaf", "key", "texts", "need", token).where(F.col("pos") >= depth)
    constant = places.groupBy("leaf", "pos", "token").agg(F.sum("texts").alias("n"), F.min("need").alias("need")).where("n >= need").select("leaf", "pos", "token")
    # lines that recur by themselves need no generalisation
    loose = places.where("texts < need").join(constant, ["leaf", "pos", "token"], "left_anti").groupBy("leaf", "key").agg(F.collect_list("pos").alias("loose"))
    general = distinct.join(loose, ["leaf", "key"]).withColumn("t", F.transform(F.split("masked", " "), lambda t, i: F.when(F.array_contains("loose", i), F.lit(FIELD)).otherwise(t)))
    general = general.where(fields(F.col("t")) <= wild).select("leaf", "key", F.xxhash64(F.concat_ws(" ", "t")).alias("template"))
    named = kept.select("id", "text_key", "line", "need", "leaf", "key").join(general, ["leaf", "key"], "left")
    template = ["template", "key"]
    if variants:
        named, template = named.join(joined_variants(distinct, depth, wild), ["leaf", "key"], "left"), ["variant", *template]
    return named.select("id", "text_key", "line", "need", F.coalesce(*template).alias("template"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, depth: int = 3, wild: float = 0.2, keep_first: bool = True, long_words: int | None = None, long_docs: int = 2, variants: bool = False, same: DataFrame | None = None) -> DataFrame:
    """``docs`` with the lines whose template recurs across texts taken out of ``text_col``.

    A template recurs if at least ``min_docs`` different texts have lines of it; copies of a whole
    document count as one text, since dropping whole copies is another operator's work. At most a
    share ``wild`` of a template's tokens are variable fields (lines are alike to 1 - wild), or the
    line stands for itself. With ``keep_first`` the document with the smallest id keeps its lines,
    so no content leaves the corpus altogether. All other lines, blank ones too, stay in order; a
    document may end up empty but stays.

    With ``long_words`` lines of more words recur from ``long_docs`` texts on. With ``variants`` a rare
    line takes the template of the nearest recurring line of its leaf that it differs from in at most
    ``wild`` of the tokens. ``same`` (text_hash: xxhash64 of a text, class) names texts that count as
    one, such as near copies; all texts of the class that holds a template's first document keep its
    lines, so that they stay alike.

    Returns the columns of ``docs`` (less any named n_lines or n_dropped), n_lines and n_dropped.
    Null and empty texts pass through with n_lines 0 and 0 dropped. Rows with a null id count as one
    document, which is never a template's first. Repeated rows are treated alike. Only lines of
    recurring leaves are shuffled with their text; one hot template is counted in tasks first.
    """
    lines = stable(line_templates(docs, id_col, text_col, min_docs, depth, wild, long_words, long_docs, variants, same))
    first_text = F.coalesce(F.min_by("text_key", "id"), F.min("text_key")).alias("first_text")
    recurring = lines.groupBy("template").agg(F.countDistinct("text_key").alias("texts"), F.min("need").alias("need"), F.min("id").alias("first"), first_text).where("texts >= need").select("template", "first", "first_text")
    drops = lines.join(recurring, "template")
    if keep_first:
        drops = drops.where(~F.col("id").eqNullSafe(F.col("first"))) if same is None else drops.where("text_key <> first_text")
    key, drop = fresh(docs, "__id", "__drop")
    drops = drops.groupBy(F.col("id").alias(key)).agg(F.collect_set("line").alias(drop))
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    text = F.col(f"`{text_col}`")
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left")
    own = F.when(text != "", F.split(text, "\n"))
    gone = lambda l: F.array_contains(drop, F.xxhash64(l))
    left = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.filter(own, lambda l: ~gone(l)), "\n"))
    count = F.coalesce(F.size(F.filter(own, gone)), F.lit(0))
    left = F.when(text.isNull() | (text == ""), text).otherwise(left)
    n_lines = F.when(text != "", F.size(F.split(text, "\n"))).otherwise(0)
    dropped = F.when(F.col(drop).isNull() | text.isNull() | (text == ""), 0).otherwise(count)
    return joined.select(*[left.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in columns], n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
