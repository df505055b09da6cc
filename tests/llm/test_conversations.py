"""Conversation repair against all edit scripts, plain Python and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sylvan.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\x0c\r"


def all_scripts(rows):
    """(cost, edits, lines) of the cheapest script, trying all of at most len(rows) + 3 edits; rows: (role, text, must go, truncated)."""
    best = None

    def go(i, cost, edits, said, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.match("".join(x[0] for x, _ in said)):
            found = cost, edits, ["%s:%s" % x for x in said]
            best = min(best or found, found)
        if inserted < 3:
            for role in ("user", "assistant"):
                go(i, cost + 5, edits + "I", [*said, (role, "")], inserted + 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, cost + 2, edits + "D", said, inserted)
            if not must:
                go(i + 1, cost + 5 * cut, edits + "K", [*said, (role or " ", text)], inserted)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * cut, edits + "R", [*said, (new, text)], inserted)

    go(0, 0, "", [], 0)
    return best


def plain(turns):
    """The result of (turn, role, text) in order, by all_scripts."""
    seen, rows, faults = set(), [], [0, 0, 0]
    for _, role, text in turns:
        blank, again = not text.strip(SPACES), (role, text) in seen
        cut = not blank and text.rstrip(SPACES)[-1] not in ".!?"
        seen.add((role, text))
        for k, fault in enumerate((blank, again, cut)):
            if fault:
                faults[k] += 1
                break
        rows.append((role, text, blank or again, cut))
    cost, edits, said = all_scripts(rows)
    have = [t for t, _, _ in turns if t is not None]
    gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return gaps, *faults, illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        own += [row] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def made_up(seed, n=120):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(r.randrange(7)):
            role = r.choice(["user", "assistant", "system", "tool", "user", "assistant", None, "", "ua"])
            text = r.choice(["Yes.", "No", "What? \n", " ", "", None, "a.b", "é!", "x" * 50 + ".", " "])
            rows.append((conv if conv % 17 else None, r.choice([None, 0, 1, 2, 2, 3, 5]), role, text))
    return rows


@pytest.mark.parametrize("long", [50_000, 2, 1])
def test_against_all_scripts(spark, long):
    """Null ids, turns, roles and texts, ties, repeated rows, a clashing column; whole and in segments."""
    rows = [r for r in made_up(3) if r[0] is not None] + [(None, 3, "user", "A."), (None, None, "assistant", "B."), (None, 9, None, "C.")]
    talks = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, code string")
    got = C.repair_conversations(C.damaged(talks), long)
    assert got.columns == C.FIELDS.names
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: plain(own) for c, own in damage(rows).items()}


def test_segments_change_nothing(spark):
    """A conversation of very many turns, against the walk over all of it."""
    r = random.Random(5)
    rows = [(1, r.randrange(300), r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "No", "", f"{k}.", f"{k}?", f"{k}"])) for k in range(1500)]
    talks = spark.createDataFrame(rows + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")
    whole, parts = (C.repair_conversations(C.damaged(talks), n).collect() for n in (50_000, 37))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 2


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repair_conversations(C.damaged(spark.createDataFrame([], schema))).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = C.repair_conversations(C.damaged(spark.createDataFrame([(7, turn, "user", "Hi.")], schema))).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_costs_and_walk():
    code = lambda initial, cut=False, must=False: initial + 4 * cut + 8 * must
    assert C.costs(b"")[0][C.START] == 0 and C.costs(bytes([code(1)]))[0][C.START] == 2  # a lone system turn goes
    for n in range(4):
        for codes in itertools.product((code(0), code(1), code(2), code(3), code(2, True), code(3, must=True)), repeat=n):
            rows = [(("tool", "system", "user", "assistant")[c & 3], "t", c >= 8, bool(c & 4)) for c in codes]
            cost, edits, _ = all_scripts(rows)
            found = C.costs(bytes(codes))
            assert (found[0][C.START], "".join(C.walk(bytes(codes), found, C.START)[0])) == (cost, edits)
