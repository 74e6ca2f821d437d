"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from .batches import fresh, stable

#: Sources up to which their table is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000

#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def document_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, source_col: str, size_col: str, weights: Sequence[float], share: float, most: float, few: bool = True) -> DataFrame:
    """Add weight and target to a table with one row per source and the sizes' sum.

    Sources by code point, null last, take ``weights`` in turn. All targets sum to ``share`` times
    all sizes, in proportion to the weights, but none exceeds ``most`` times its source's size: the
    excess goes to the others by weight until none is above. With the sources in ascending order of
    most * size / weight, the capped ones are a prefix; the level of the rest is what is left of the
    total over what is left of the weights. With ``few`` sources windows run over all of them; else
    the running totals come from range sorts.
    """
    name = F.col(source_col).asc_nulls_last()
    if few:
        turned = sizes.withColumn("__turn", F.row_number().over(Window.orderBy(name)) - 1)
    else:
        turned = running_totals(sizes, [name], {"__turn": F.lit(1)})
    turn = F.pmod(F.col("__turn"), F.lit(len(weights)))
    rows = turned.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).drop("__turn")
    rows = rows.withColumn("__cap", F.col(size_col) * F.lit(float(most))).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    order = [F.col("__ratio"), name]
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__caps", F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn("__weights", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    else:
        rows = running_totals(rows, order, {"__caps": F.col("__cap"), "__weights": F.col("weight")})
    whole = F.broadcast(rows.agg(F.sum(size_col).alias("__all"), F.sum("weight").alias("__weight")))  # one row
    level = (F.col("__all") * F.lit(float(share)) - F.col("__caps")) / (F.col("__weight") - F.col("__weights"))
    levels = rows.crossJoin(whole).withColumn("__level", level)
    # the first source that reaches the level without its cap sets it for all that follow
    reached = levels.where(F.col("__level") <= F.col("__ratio")).agg(F.min(F.struct("__ratio", F.col(source_col).isNull(), source_col, "__level")).alias("__first"))
    reached = F.broadcast(reached.select(F.coalesce(F.col("__first.__level"), F.lit(float("inf"))).alias("__least")))
    out = rows.crossJoin(reached).withColumn("target", F.least(F.col("__cap"), F.col("__least") * F.col("weight")))
    return out.drop("__cap", "__ratio", "__caps", "__weights", "__least")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    Adds to the columns of ``docs``, or those that ``carry`` names: size, source_size, target (its
    source's), rate (target over source_size) and copies: floor(rate), plus one with probability
    rate - floor(rate), drawn from a hash of the document's id and the seed, so that reruns agree.
    Columns of those names in ``docs`` give way. Null and empty texts have size 0; a null source is a
    source of its own; a source without words has target 0 and rate 0. Repeated rows count each and
    share their id's draw. Sizes are summed within tasks first, so one source may hold any part of
    the rows; only one row per source is joined back. Without the text among the carried columns the
    texts are read once, and the sizes are kept instead. An empty table gives an empty one.
    """
    made = ["size", "source_size", "target", "rate", "copies"]
    named = {source_col.lower(), id_col.lower(), text_col.lower()}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() in named or c.lower() not in made]
    with_text = text_col.lower() in [c.lower() for c in keep]
    source, size, key, sum_, goal, rate_, draw = fresh(docs, "__source", "__size", "__key", "__sum", "__goal", "__rate", "__draw")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], document_size(F.col(f"`{text_col}`")).alias(size), F.col(f"`{source_col}`").alias(source), unit_hash(F.col(f"`{id_col}`"), seed).alias(draw))
    if not with_text:
        rows = stable(rows)
    sums = rows.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.sum(size).alias("__source_size"))
    sums = stable(sums)
    few = sums.count() <= BROADCAST_SOURCES
    targets = stable(source_targets(sums, "__source", "__source_size", weights, share, most, few))
    targets = targets.select(F.col("__source").alias(key), F.col("__source_size").alias(sum_), F.col("target").alias(goal))
    joined = rows.join(F.broadcast(targets) if few else targets, F.col(source).eqNullSafe(F.col(key)), "left")
    joined = joined.withColumn(rate_, F.when(F.col(sum_) > 0, F.col(goal) / F.col(sum_)).otherwise(F.lit(0.0)))
    copies = (F.floor(rate_) + F.when(F.col(draw) < F.col(rate_) - F.floor(rate_), 1).otherwise(0)).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.col(size).alias("size"), F.col(sum_).alias("source_size"), F.col(goal).alias("target"), F.col(rate_).alias("rate"), copies.alias("copies"))


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, none where that is null or 0; rows that repeat repeat as often each."""
    n = fresh(mixed, "__n")[0]
    return mixed.where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
