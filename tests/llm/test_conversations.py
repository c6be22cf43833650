import hashlib
import random
import zlib

import pytest

from oreworks.llm import conversations
from oreworks.llm.conversations import Settings, damage, repair

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
ORDER = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) by a table over (row, last initial) that compares whole strings. rows: (initial, fault)."""
    inserts = {"": "u", "s": "u", "u": "a", "a": "u"}
    behind = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for initial, fault in reversed(rows):
        extra = 5 if fault == "truncated" else 0
        here = {}
        for last in ORDER:
            ways = [(2 + behind[last][0], "D" + behind[last][1])]
            if fault not in ("blank", "duplicate"):
                if initial and initial in ORDER[last]:
                    ways.append((extra + behind[initial][0], "K" + behind[initial][1]))
                to = inserts[last]
                ways.append((1 + extra + behind[to][0], "R" + behind[to][1]))
            here[last] = min(ways)
        for _ in range(3):  # inserts before the row
            for last in ORDER:
                cost, audit = here[inserts[last]]
                here[last] = min(here[last], (5 + cost, "I" + audit))
        behind = here
    return behind[""]


def brute_force(rows):
    """Results by conversation, from the damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = [c for c in text if c not in WHITE]
            if not solid:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        symbols = [(r[2][:1] if r[2][:1] in ("s", "u", "a") else None, f) for r, f in zip(own, faults)]
        cost, audit = cheapest(symbols)
        last, at, lines = "", 0, []
        for edit in audit:
            if edit in "IR":
                last = "a" if last == "u" else "u"
            if edit == "K":
                last = own[at][2][:1]
            name = own[at][2] if edit == "K" else {"u": "user", "a": "assistant"}.get(last)
            if edit != "D":
                lines.append(f"{name}:{'' if edit == 'I' else own[at][3]}")
            at += edit != "I"
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def results(spark, rows, **settings):
    found = repair(damage(spark.createDataFrame(rows, ROWS)), Settings(**settings)).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:]) for r in found}


def talk(rng, convs, turns):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula"]
    texts = ["Yes.", "No!", "why", "  ", "", None, " ", "A. \n", "Is it? .", "🙂.", "…"] + [f"t{k}." for k in range(30)]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, turns)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn, 3, None]), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block_rows", [200_000, 7, 2])
def test_repairs_match_brute_force_whatever_the_blocks(spark, block_rows):
    rows = talk(random.Random(block_rows), [None, *range(60)], 14)
    # One conversation has a third of the rows, another one row many times.
    rows += talk(random.Random(3), [1000], 3)[:1] + [(1000, t, ["user", "assistant"][t % 3 % 2], f"x{t % 90}.") for t in range(150)]
    rows += [(1001, 5, "user", "same.")] * 40 + [(1002, k, "user", f"never {k}.") for k in range(70)]
    rng = random.Random(1)
    rng.shuffle(rows)
    assert results(spark, rows, block_rows=block_rows) == brute_force(rows)


def test_the_given_conversations(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in given.collect()]
    assert results(spark, rows, block_rows=100) == brute_force(rows)


def test_no_rows_dropped_rows_and_other_columns(spark):
    assert results(spark, []) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert results(spark, [(gone, 0, "user", "Hi.")]) == {gone: nothing}
    rows = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, True, "x")], f"{ROWS}, copies int, no_id boolean, edits string")
    assert [tuple(r) for r in repair(damage(rows)).collect()] == [(gone, *nothing)]


def test_runs_are_unrolled_in_bounded_steps():
    # A long run of one symbol: powers must agree with row by row steps, and unrolling is lazy.
    for symbol in range(9):
        after = conversations.END
        for _ in range(37):
            after = conversations.advance(symbol, 1, after)
        assert after == conversations.advance(symbol, 37, conversations.END)
    walk = conversations.unroll(2, 10**12, conversations.NOTHING, conversations.END)
    assert "".join(next(walk)[0] for _ in range(6)) == "KRKRKR"


def test_very_long_texts_and_turns_far_apart(spark):
    rows = [(1, -(2**62), "user", "a" * 3_000_000 + "."), (1, 2**62, "assistant", "b. " + " " * 1_000_000), (2, 7, "system", "S.")]
    found = results(spark, rows)
    assert {k: v[1:] for k, v in found.items()} == {k: v[1:] for k, v in brute_force(rows).items()}
    assert found[1][0] == 2**63 - 1
