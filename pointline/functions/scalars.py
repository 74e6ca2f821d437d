"""Column functions on ids, dates, scores, names and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Country code where none is known.
UNKNOWN_COUNTRY = "UNK"
#: Accented Latin letters and the letters they fold to.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇŠŽ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncszAAAAAAEEEEIIIIOOOOOUUUUYNCSZ"


def event_id(tournament: Column, sequence: Column, year: Column) -> Column:
    """Year, tournament and three-digit sequence; a tournament that begins with the year has it already.

    A year given as YYYYMMDD counts as its year; sequences of more digits keep them all.
    """
    tid, own = F.trim(tournament), F.when(year > 9999, F.floor(year / 10000)).otherwise(year).cast("int").cast("string")
    body = F.concat_ws("-", tid, F.format_string("%03d", sequence.cast("int")))
    return F.when(own.isNull() | tid.startswith(own), body).otherwise(F.concat_ws("-", own, body))


def sequence_of(code: Column) -> Column:
    """The number of an ms code; 0 if it is malformed."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"^[mM][sS]([0-9]{1,9})$", 1), F.lit("")).try_cast("int"), F.lit(0))


def safe_int(c: Column, default: int | None = 0) -> Column:
    value = c.try_cast("double").try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def positive_rank(c: Column) -> Column:
    value = safe_int(c, None)
    return F.when(value > 0, value)


def safe_float(c: Column, default: float = 0.0) -> Column:
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def canonical_surface(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("clay", "grass", "hard", "carpet"), low).otherwise(F.lit("hard"))


def canonical_indoor(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("i", "1"), 1).when(low.isin("o", "0"), 0).cast("short")


def canonical_country(c: Column) -> Column:
    """Trimmed upper case; blank is unknown. Whether a code exists is a join with the known codes."""
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit(UNKNOWN_COUNTRY))


def clean_score(score: Column) -> Column:
    """The score without tie-break points in parentheses; null where none is recorded."""
    text = F.trim(score)
    return F.when(~text.isin("", "0", "0.0", "nan"), F.trim(F.regexp_replace(text, r"\([0-9]+\)", "")))


def completed_sets(score: Column) -> Column:
    """Tokens of the form games-games."""
    return F.coalesce(F.size(F.filter(F.split(clean_score(score), r"\s+"), lambda t: t.rlike("^[0-9]+-[0-9]+$"))), F.lit(0))


def best_of(raw: Column, level: Column, round_: Column, score: Column) -> Column:
    """A trusted 1, 3 or 5; else 1 for round robin, 5 for slams and four sets or more, else 3."""
    value = safe_int(raw, None)
    return F.when(value.isin(1, 3, 5), value).when(F.lower(round_) == "rr", 1).when((level == "grand_slam") | (completed_sets(score) >= 4), 5).otherwise(3).cast("short")


def set_score(mine: Column, theirs: Column) -> Column:
    """'6-4 7-5' from two lists of games; null where they don't align."""
    joined = F.array_join(F.zip_with(mine, theirs, lambda a, b: F.concat_ws("-", a, b)), " ")
    return F.when((F.size(mine) == F.size(theirs)) & (F.size(mine) > 0) & ~F.exists(mine, lambda x: x.isNull()) & ~F.exists(theirs, lambda x: x.isNull()), joined)


def score_segments(score: Column, winner_view: Column) -> Column:
    """Sets with a flag for those that the viewing side won; the score is the winner's."""
    part = lambda s, i: F.regexp_extract(s, r"^([0-9]+)-([0-9]+)", i).try_cast("int")
    ahead = lambda s: F.when(winner_view, part(s, 1) > part(s, 2)).otherwise(part(s, 1) < part(s, 2))
    return F.transform(F.split(score, " "), lambda s: F.struct(s.alias("text"), F.coalesce(ahead(s), F.lit(False)).alias("bold")))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "")


def reversed_name_key(c: Column) -> Column:
    return name_key(F.array_join(F.reverse(F.split(F.trim(c), r"\s+")), " "))


#: Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _date(day: Column, month: Column, year: Column) -> Column:
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("int")
    return F.when(number > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year.try_cast("int"), number, day.try_cast("int"))))


def date_range(text: Column, year: Column) -> tuple[Column, Column]:
    """Start and end of '18 January - 1 February, 2026', '2 - 11 January, 2026' or one date.

    A start month after the end month is of the year before; an end without a month gives nulls.
    """
    parts = F.split(F.trim(text), "\\s*[-\u2013]\\s*")
    piece = r"^([0-9]{1,2})\s*([A-Za-z]+)?\s*,?\s*([0-9]{4})?$"
    get = lambda s, i: F.nullif(F.regexp_extract(s, piece, i), F.lit(""))
    first, last = F.trim(F.element_at(parts, 1)), F.trim(F.element_at(parts, -1))
    number = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m))
    own = F.coalesce(get(last, 3), year.cast("string"))
    end = _date(get(last, 1), get(last, 2), own)
    month = F.coalesce(get(first, 2), get(last, 2))
    before = F.when(number(month) > number(get(last, 2)), own.try_cast("int") - 1).otherwise(own.try_cast("int"))
    return F.when(F.size(parts) == 1, end).otherwise(_date(get(first, 1), month, before.cast("string"))), end


def minutes_of(clock: Column) -> Column:
    """Minutes of HH:MM:SS, to the nearest with halves to even; null where malformed."""
    part = F.split(clock, ":")
    n = [part[i].try_cast("int") for i in range(3)]
    return F.when((F.size(part) == 3), F.bround(n[0] * 60 + n[1] + n[2] / 60.0).cast("int"))


def age_at(birth: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, birth) / 12).cast("int")


def clip_probability(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip_probability(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def antisymmetric_evidence(p_ab: Column, p_ba: Column) -> Column:
    return (logit(p_ab) - logit(p_ba)) / F.lit(2.0)


def temperature_scaled(p: Column, t: Column) -> Column:
    return sigmoid(t * logit(p))


def benchmark_delta(x: Column, y: Column) -> Column:
    return x - y


def rank_label(rank: Column, known: Column) -> Column:
    return F.when(rank.isNotNull(), rank.cast("string")).when(known, F.lit("200+")).otherwise(F.lit("N/A"))


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(F.round(x * 100, places), places), F.lit("%"))


def decimal_odds(p: Column) -> Column:
    return F.when(p > 0, F.round(F.lit(1.0) / p, 2))


def signed_text(x: Column, places: int = 1) -> Column:
    return F.when(x > 0, F.concat(F.lit("+"), F.format_number(x, places))).otherwise(F.format_number(x, places))


def record_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def md5_bucket(c: Column, buckets: int = 256) -> Column:
    return (F.conv(F.substring(F.md5(c), 17, 8), 16, 10).cast("long") % buckets).cast("int")


def is_finite(c: Column) -> Column:
    value = c.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def previous_monday(day: Column) -> Column:
    """The last Monday on or before a day."""
    return F.date_sub(F.next_day(day, "MON"), 7)
