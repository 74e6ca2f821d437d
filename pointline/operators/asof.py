"""Point-in-time joins by window: no row meets more than one growing frame of its own key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior_state(rows: DataFrame, key: Sequence[str], date: str, state: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Add the greatest ``state`` struct of the key's rows with a strictly earlier date.

    For events that are their own snapshots: ``state`` begins with date and tie-break, so the
    greatest is the latest. With ``inclusive`` rows of the same date count too.
    """
    frame = Window.partitionBy(*key).orderBy("__day").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn("__day", F.unix_date(date)).withColumn(name, F.max(state).over(frame)).drop("__day")


def as_of_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_date: str, right_date: str, values: Sequence[str], tie: Sequence[str] = (), inclusive: bool = False, prefix: str = "") -> DataFrame:
    """Left outer as-of join: each left row with the latest earlier right row of its key.

    ``tie`` columns, the larger first, order right rows of one date. Both sides go through one
    shuffle on the key and one window; a right row isn't paired with the left rows it can't serve.
    Left rows with a null key or date get nulls.
    """
    state = F.struct(F.col(right_date).alias("__date"), *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    lefts = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.unix_date(left_date).alias("__day"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"))
    rights = right.where(F.col(right_date).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.unix_date(right_date).alias("__day"), state.alias("__state"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    frame = Window.partitionBy(*[f"__k{i}" for i in range(len(key))]).orderBy("__day").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    known = F.col("__day").isNotNull()
    for i in range(len(key)):
        known &= F.col(f"__k{i}").isNotNull()
    found = both.withColumn("__found", F.max("__state").over(frame)).where("__left IS NOT NULL")
    return found.select("__left.*", *[F.when(known, F.col(f"__found.__v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)])


def last_n_prior(events: DataFrame, a: str, b: str, date: str, tie: str, values: Sequence[str], n: int = 5, name: str = "prior") -> DataFrame:
    """Add the n newest strictly earlier meetings of each row's unordered pair, newest first.

    Each meeting is a struct of date, tie and ``values``. The list is made on the first row of a pair
    and date and shared with the rows of that date, so meetings of one day never see each other.
    """
    meeting = F.struct(F.col(date).alias("date"), F.col(tie).alias("tie"), *[F.col(v) for v in values])
    rows = events.select("*", F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi"))
    by_time = Window.partitionBy("__lo", "__hi").orderBy(date, tie)
    rows = rows.withColumn("__list", F.collect_list(meeting).over(by_time.rowsBetween(-n, -1)))
    first = F.first("__list").over(Window.partitionBy("__lo", "__hi", date).orderBy(tie))
    return rows.withColumn(name, F.reverse(first)).drop("__list", "__lo", "__hi")


def last_n_prior_for(requests: DataFrame, events: DataFrame, a: str, b: str, date: str, tie: str, values: Sequence[str], n: int = 5, name: str = "prior") -> DataFrame:
    """As last_n_prior, for rows of another table; ``a``, ``b`` and ``date`` name columns of both.

    Meetings of a pair get even places in time order and a request the odd place after the last
    meeting before its date, so a frame of n meetings ends right before it.
    """
    pair = [F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi"), F.unix_date(date).alias("__day")]
    asked = requests.select(*pair, F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("__ask"))
    meeting = F.struct(F.col(date).alias("date"), F.col(tie).alias("tie"), *[F.col(v) for v in values]).alias("__meeting")
    both = asked.unionByName(events.select(*pair, meeting), allowMissingColumns=True)
    real = F.col("__meeting").isNotNull()
    before = F.count_if(real).over(Window.partitionBy("__lo", "__hi").orderBy("__day").rangeBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy("__lo", "__hi", real).orderBy("__day", "__meeting.tie"))
    placed = both.withColumn("__x", F.when(real, 2 * place.cast("long")).otherwise(2 * before + 1))
    found = F.collect_list("__meeting").over(Window.partitionBy("__lo", "__hi").orderBy("__x").rangeBetween(1 - 2 * n, -1))
    return placed.withColumn(name, F.reverse(found)).where("__ask IS NOT NULL").select("__ask.*", name)
