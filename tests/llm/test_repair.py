"""Conversation repair: the search against a dynamic programme and enumeration, pieces against whole."""

import itertools
import random
import re

import pytest

from tracewell.llm import repair
from tracewell.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, digest string, part int, x int"


def closed(states):
    for _ in range(3):
        for q, (cost, audit) in list(states.items()):
            way = (cost + 3, audit + "I")
            after = repair._NEXT[q]
            if after not in states or way < states[after]:
                states[after] = way
    return states


def programme(codes, entry=repair.NONE, exits=repair._ENDS, last=True):
    states = {entry: (0, "")}
    for row in codes:
        new = {}
        for q, (cost, audit) in closed(states).items():
            ways = [(q, cost + 4, "D")]
            if row not in "bd":
                more = 3 if row.isupper() else 0
                ways.append((repair._NEXT[q], cost + 3 + more, "R"))
                if (row.lower(), q) in repair._KEEP:
                    ways.append((repair._KEEP[row.lower(), q], cost + more, "K"))
            for after, price, edit in ways:
                new[after] = min(new.get(after, (10**9, "")), (price, audit + edit))
        states = new
    states = closed(states) if last else states
    return min((states[q] for q in exits if q in states), default=None)


def test_search_equals_a_dynamic_programme():
    pick = random.Random(5)
    for _ in range(3000):
        codes = "".join(pick.choice("suaxSUAXbduaua") for _ in range(pick.randint(0, 9)))
        assert repair.search(codes) == programme(codes)
        entry, state = pick.randrange(4), pick.randrange(4)
        assert repair.search(codes, entry, (state,), False) == programme(codes, entry, (state,), False)


def test_search_equals_enumeration():
    """All strings of edits of a few letters, judged by the grammar alone."""
    grammar = re.compile("(s?(ua)+)?")
    for codes in ("", "u", "a", "s", "uS", "ub", "sa", "aU", "ax"):
        found = []
        for size in range(len(codes) + 5):
            for audit in itertools.product("DIKR", repeat=size):
                rows = [e for e in audit if e != "I"]
                if len(rows) != len(codes) or any(c in "bd" and e != "D" for c, e in zip(codes, rows)):
                    continue
                kept = [(e, c) for e, c in zip(rows, codes)]
                cost = sum({"K": 0, "R": 3, "D": 4}[e] + (3 if c.isupper() and e != "D" else 0) for e, c in kept) + 3 * audit.count("I")
                left = iter(codes)
                slots = ["ua" if e == "I" else ("ua" if e == "R" else c.lower()) for e, c in ((e, "" if e == "I" else next(left)) for e in audit) if e != "D"]
                if any(grammar.fullmatch("".join(roles)) for roles in itertools.product(*slots)):
                    found.append((cost, "".join(audit)))
        assert repair.search(codes) == min(found), codes


def test_chained_pieces_equal_the_whole():
    pick = random.Random(6)
    for _ in range(300):
        parts = ["".join(pick.choice("suaxSUAXbduaua") for _ in range(pick.randint(1, 5))) for _ in range(pick.randint(1, 5))]
        matrices = [repair.matrix(p) for p in parts]
        cuts, audit, cost = repair.route(matrices, repair.NONE, repair._TAIL), "", 0
        for i, part in enumerate(parts):
            final = i == len(parts) - 1
            price, edits = repair.search(part, cuts[i], repair._ENDS if final else (cuts[i + 1],), final)
            audit, cost = audit + edits, cost + price
        assert (cost, audit) == programme("".join(parts))
        whole = matrices[0]
        for m in matrices[1:]:
            whole = repair.chained(whole, m)
        assert whole == repair.matrix("".join(parts))


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    with Scratch(spark) as scratch:
        return sorted((tuple(r) for r in repair.repaired(scratch, frame).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_known_conversation(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello"), (1, 1, "assistant", "Hello"), (1, 4, "user", " \t"), (2, None, "system", "Be."), (3, 5, None, None)]
    assert run(spark, rows) == [
        (1, 2, 1, 1, 1, 1, 11, "KKDD", "user:Hi.\nassistant:Hello"),
        (2, 0, 0, 0, 0, 0, 4, "D", ""),
        (3, 0, 1, 0, 0, 0, 4, "D", ""),
    ]
    assert run(spark, []) == []


@pytest.mark.parametrize("piece", [256, 3])
def test_hot_conversation_is_cut_and_put_together(spark, conf, monkeypatch, piece):
    """One conversation (and the rows without an id) over several tasks equals the plain result."""
    monkeypatch.setattr(repair, "PIECE", piece)
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pick = random.Random(9)
    rows = []
    for conv, size in ((7, 150), (None, 60), (8, 5), (9, 1)):
        for turn in range(size):
            text = pick.choice(["Yes.", "No", "", " ", f"Row {turn}!", f"row {turn}"])
            rows.append((conv, pick.choice([turn, turn, None]), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), text))
    import hashlib

    want = []
    for conv in (None, 7, 8, 9):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, codes = set(), ""
        for _, _, role, text in own:
            codes += repair.code(role, text, (role, text) not in seen)
            seen.add((role, text))
        whole = repair.Conversation(False)
        whole.add([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], codes, programme(codes)[1])
        want.append((conv, *whole.result()))
        assert whole.cost == programme(codes)[0]
    assert run(spark, rows) == want
