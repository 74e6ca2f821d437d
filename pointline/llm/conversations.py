"""Conversation structure repair by Hirschberg's divide and conquer.

A legal conversation is empty, or an optional system row and then pairs of a user's and an
assistant's row. Four states say what has been written: nothing, a system row, a user's, an
assistant's row. For a stretch of rows, the forward vector holds the least cost of reaching each
state at its middle from a state at its start, the backward vector the least cost of going on from
there to a state at its end; where the sum is least, an optimal script of edits crosses the middle.
Both halves are solved alike, so that no table of rows by states is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import written

# White space, ends of sentences, roles by initial, costs of edits.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
INITIALS = "sua"
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
FAULTS = ("none", "blank", "duplicate", "truncated")

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by the state before and the row's initial.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after a row with the role that comes next.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NEVER = 1 << 60


def row_scripts(initial: str, fault: int) -> list[list[tuple[int, str]]]:
    """[from][to]: least cost and, among the cheapest, the first script of one row's edit with insertions about it."""
    best = [[(NEVER, "")] * 4 for _ in range(4)]

    def inserted(state: int) -> list[tuple[int, int]]:
        out = [(state, 0)]
        for n in (1, 2):
            out.append((NEXT[out[-1][0]], n))
        return out

    for start in range(4):
        for state, before in inserted(start):
            edits = [(state, DELETE, "D")]
            if fault not in (1, 2):
                more = UNFINISHED if fault == 3 else 0
                edits.append((NEXT[state], REROLE + more, "R"))
                if (state, initial) in KEPT:
                    edits.append((KEPT[state, initial], more, "K"))
            for made, cost, letter in edits:
                for end, after in inserted(made):
                    best[start][end] = min(best[start][end], (cost + INSERT * (before + after), "I" * before + letter + "I" * after))
    return best


#: One kind for each initial (others are one) and fault.
KINDS = [row_scripts(i, f) for i, f in product([*INITIALS, ""], range(4))]
COSTS = [[[cell[0] for cell in row] for row in kind] for kind in KINDS]
#: The same with the states exchanged, for going backwards.
BACK = [[list(column) for column in zip(*kind, strict=True)] for kind in COSTS]


def vector(kinds: Iterable[int], state: int, costs: list) -> list[int]:
    """Least cost of each state after the rows ``kinds``, from ``state``."""
    now = [NEVER] * 4
    now[state] = 0
    for k in kinds:
        w, x, y, z = now
        a, b, c, d = costs[k]
        now = [min(w + a[j], x + b[j], y + c[j], z + d[j]) for j in range(4)]
    return now


def least_scripts(kinds: bytes, low: int, high: int, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """The first of the cheapest scripts of rows low .. high, for each wanted pair of states at their ends.

    Of crossings that cost the same, that with the first script of the left half is right: scripts
    to different states differ, and where one begins with the other, the rest of the shorter one can
    go on as the longer one does.
    """
    if high - low == 1:
        return {(a, b): KINDS[kinds[low]][a][b][1] for a, b in wanted}
    middle = (low + high) // 2
    left_rows, right_rows = kinds[low:middle], kinds[middle:high][::-1]
    forward = {a: vector(left_rows, a, COSTS) for a in {a for a, _ in wanted}}
    backward = {b: vector(right_rows, b, BACK) for b in {b for _, b in wanted}}
    crossings = {}
    for a, b in wanted:
        sums = [x + y for x, y in zip(forward[a], backward[b], strict=True)]
        crossings[a, b] = [m for m in range(4) if sums[m] == min(sums)]
    left = least_scripts(kinds, low, middle, {(a, m) for (a, b), tied in crossings.items() for m in tied})
    chosen = {(a, b): min(tied, key=lambda m: left[a, m]) for (a, b), tied in crossings.items()}  # noqa: B023
    right = least_scripts(kinds, middle, high, {(m, b) for (_, b), m in chosen.items()})
    return {(a, b): left[a, m] + right[m, b] for (a, b), m in chosen.items()}


def least_edits(kinds: bytes) -> tuple[int, str]:
    """Cost and script of the cheapest edits of a conversation; ties to the script that comes first."""
    if not kinds:
        return 0, ""
    costs = vector(kinds, NOTHING, COSTS)
    cost = min(costs[NOTHING], costs[ASSISTANT])
    found = least_scripts(kinds, 0, len(kinds), {(NOTHING, s) for s in (NOTHING, ASSISTANT) if costs[s] == cost})
    return cost, min(found.values())


def ordered_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text; null roles and texts as one space."""
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))


def row_order() -> list[Column]:
    return [F.col("conv"), F.col("head").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def audit_conversations(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults and cheapest repair of each conversation.

    Rows stand by turn, nulls first, then role and text; a null role or text counts as one space, and
    rows without ``conv_col`` are one conversation. ``every`` may hold further conversations, which
    come out with zeros if they have no rows. Returns ``conv_col`` and

    - gaps: turns missing between the first and the last, nulls aside;
    - blank, duplicate, truncated: rows by their first fault: nothing but white space; role and text
      of an earlier row; no sentence's end at the end;
    - illegal: neighbours whose roles can't follow one another;
    - cost and audit: the cheapest edits that make a legal conversation, by initial (Keep, Rerole,
      Delete, Insert), ties to the audit that comes first. Blank rows and duplicates are deleted.

    Further columns take no part. No rows give no rows. A conversation's rows stream by in order, and
    a task holds one byte for each row of one conversation, never its texts.
    """
    own = ordered_rows(rows, conv_col, turn_col, role_col, text_col).withColumn("head", F.lit(False))
    if every is not None:
        heads = every.select(F.col(f"`{conv_col}`").alias("conv")).distinct().select("conv", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))], F.lit(True).alias("head"))
        own = own.unionByName(heads)
    alike = Window.partitionBy("conv").orderBy("head", "role", "text", F.col("turn").asc_nulls_first())
    before = lambda c: F.lag(c).over(alike)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", 1).when((before("role") == F.col("role")) & (before("text") == F.col("text")), 2).when(~F.right(bare, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") == "") | (initial == 0), len(INITIALS)).otherwise(initial - 1)
    told = own.repartition("conv").withColumn("kind", F.when(F.col("head"), -1).otherwise(4 * initial + fault).cast("int"))
    told = told.sortWithinPartitions(*row_order()).select("conv", "turn", "kind")
    names = [conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    legal = {INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, kinds, turns = (), bytearray(), [None, None, 0]  # first, last, different

        def summary() -> list:
            cost, audit = least_edits(bytes(kinds))
            counts = [sum(kinds.count(4 * i + f) for i in range(4)) for f in (1, 2, 3)]
            illegal = sum((a >> 2) * 4 + (b >> 2) not in legal for a, b in zip(kinds, kinds[1:]))  # noqa: B905
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return [conv[0], gaps, *counts, illegal, cost, audit]

        for batch in batches:
            out = []
            for c, turn, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != (c,):
                    if conv:
                        out.append(summary())
                    conv, kinds, turns = (c,), bytearray(), [None, None, 0]
                if kind >= 0:
                    kinds.append(kind)
                    if turn is not None and turn != turns[1]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if out:
                yield packed(out)
        if conv:
            yield packed([summary()])

    kind = own.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind)] + [pa.int64()] * 6 + [pa.string()]

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return told.mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", audit string")


def repaired_rows(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_col``, place (from 0), turn, role, text and edit of each row that stays.

    ``audits`` are those of the same rows. Inserted rows have no turn and an empty text; deleted ones
    are left out. A conversation's rows follow one another in order within a partition. They stream
    past its audit, so that no texts are held.
    """
    own = ordered_rows(rows, conv_col, turn_col, role_col, text_col).withColumn("head", F.lit(False)).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(f"`{conv_col}`").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("head"), "audit")
    told = own.unionByName(heads).repartition("conv").sortWithinPartitions(*row_order())
    kind = told.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    conv_type, spoken = to_arrow_type(kind), {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state = None, "", 0, 0, NOTHING
        for batch in batches:
            out = []

            def put(edit: str, turn, role, text) -> None:
                nonlocal place, state
                if edit == "K":
                    state = KEPT[state, role[0]]
                else:
                    state = NEXT[state]
                    role = spoken[state]
                out.append((conv, place, turn, role, text, edit))  # noqa: B023
                place += 1

            def inserts() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put("I", None, None, "")  # noqa: B023
                    at += 1

            for c, turn, role, text, head, script in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if head:
                    inserts()
                    conv, audit, at, place, state = c, script, 0, 0, NOTHING
                    continue
                inserts()
                if audit[at] != "D":
                    put(audit[at], turn, role, text)
                at += 1
            if out:
                yield packed(out)
        out = []
        while at < len(audit):
            state = NEXT[state]
            out.append((conv, place, None, spoken[state], "", "I"))
            at, place = at + 1, place + 1
        if out:
            yield packed(out)

    types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [conv_col, "place", "turn", "role", "text", "edit"]

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return told.select("conv", "turn", "role", "text", "head", "audit").mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, place long, turn long, role string, text string, edit string")


def digest_conversations(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(``conv_col``, repaired_sha256) of the lines ``role:text`` of conversations as repaired_rows leaves them."""
    kind = repaired.schema[conv_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(kind)

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([d for _, d in out])], names=[conv_col, "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = (), None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if place == 0:
                    if conv:
                        out.append((conv[0], digest.hexdigest()))
                    conv, digest = (c,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield packed(out)
        if conv:
            yield packed([(conv[0], digest.hexdigest())])

    return repaired.select(F.col(f"`{conv_col}`"), "place", "role", "text").mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """audit_conversations with the repaired conversation's digest; that of nothing where no row stays."""
    audits = written(audit_conversations(rows, every, conv_col, turn_col, role_col, text_col), "audits")
    digests = digest_conversations(repaired_rows(rows, audits, conv_col, turn_col, role_col, text_col), conv_col)
    digests = digests.select(F.col(f"`{conv_col}`").alias("__conv"), F.col("repaired_sha256").alias("__digest"))
    joined = audits.join(digests, F.col(f"`{conv_col}`").eqNullSafe(F.col("__conv")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in audits.columns], F.coalesce("__digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
