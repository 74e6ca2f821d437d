"""Conversation repair against all scripts of edits, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from pointline.llm.conversations import audit_conversations, least_edits, repair_conversations, repaired_rows

LEGAL = re.compile(r"(s?(ua)+)?$")


def all_scripts(rows):
    """Cost and script of the best of all scripts for rows of (initial, fault), tried one by one."""
    best = [3 * len(rows) + 1, ""]

    def go(i, out, cost, script):
        if cost > best[0] or not re.match(r"s?(ua)*u?$", out):
            return
        if i == len(rows) and LEGAL.match(out):
            best[:] = min(best, [cost, script])
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, out, cost + 3, script + "D")
            if fault not in (1, 2):
                go(i + 1, out + (initial or "x"), cost + (fault == 3), script + "K")
                for c in "ua":
                    go(i + 1, out + c, cost + 2 + (fault == 3), script + "R")
        for c in "ua":
            go(i, out + c, cost + 2, script + "I")

    go(0, "", 0, "")
    return tuple(best)


@pytest.mark.parametrize("seed", range(30))
def test_least_edits_equal_all_scripts(seed):
    r = random.Random(seed)
    for _ in range(20):
        rows = [(r.choice(["s", "u", "a", "a", "u", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 5))]
        assert least_edits(bytes(4 * ["s", "u", "a", ""].index(i) + f for i, f in rows)) == all_scripts(rows)


def described(rows):
    """What the audit says of one conversation's rows (turn, role, text), by plain loops."""
    rows = sorted(((t is not None, t or 0), " " if r is None else r, " " if x is None else x) for t, r, x in rows)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for (known, t), _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = all_scripts([(i if i in "sua" else "", f) for i, f in zip(initials, faults)])
    lines, it = [], iter(rows)
    for letter in audit:
        state = (lines[-1][0] if lines else "") or ""
        new = "assistant" if state == "u" else "user"
        if letter == "I":
            lines.append(f"{new}:")
            continue
        _, role, text = next(it)
        if letter != "D":
            lines.append(f"{role if letter == 'K' else new}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, digest), lines


def test_operator_equals_plain_loops_on_odd_rows(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 5)):
            row = (conv, r.choice([turn, turn, turn, None, turn + 3, 0]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No!", "why", "", " \t", None, "Yes.", "x" * 3000 + "?"]))
            rows += [row] * r.choice([1, 1, 1, 2])
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, AUDIT int")
    every = spark.createDataFrame([(c,) for c in [*range(42), None, 41]], "conv_id long")
    got = {x[0]: tuple(x)[1:] for x in repair_conversations(df, every=every).collect()}
    wanted = {c: described([x[1:] for x in rows if x[0] == c]) for c in [*range(42), None]}
    assert got == {c: w for c, (w, _) in wanted.items()}
    assert got[41] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    whole = {}
    for x in repaired_rows(df, audit_conversations(df)).collect():
        whole.setdefault(x.conv_id, []).append((x.place, f"{x.role}:{x.text}"))
    assert {c: [t for _, t in sorted(v)] for c, v in whole.items()} == {c: lines for c, (_, lines) in wanted.items() if lines}
    assert repair_conversations(df.limit(0)).count() == 0


def test_long_conversation_keeps_linear_space():
    r = random.Random(1)
    kinds = bytes(4 * r.choice([0, 1, 1, 2, 2, 3]) + r.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(5_000))
    cost, audit = least_edits(kinds)
    edits = [a for a in audit if a != "I"]
    assert len(edits) == 5_000
    paid = sum({"K": 0, "R": 2, "D": 3}[e] + (k % 4 == 3 and e != "D") for e, k in zip(edits, kinds)) + 2 * audit.count("I")
    assert paid == cost
