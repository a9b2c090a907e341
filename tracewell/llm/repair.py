"""Repair of the structure of conversations by the cheapest edits.

A conversation should be nothing, or an optional system row and then pairs of a user and an
assistant row. Rows may be kept, get another role, be deleted, and empty rows be inserted
(``COST``). The edits are a path through a lattice of (rows passed, last role); forward and
reverse heaps (bidirectional Dijkstra) meet in it, finish all crossings of the least cost, and
the least string of edits over these is the audit.

Rows are sorted by range of (conversation, turn, role, text digest), so that a conversation
with very many rows is cut over several tasks, and tasks read them in order. First rows of a
text carry a mark from an aggregate, so no task holds the texts it has seen. What lies within a
task is repaired there in one go. Longer conversations, and those at the border of a task, are
pieces of at most ``PIECE`` rows: for each piece the cost and the order of the audits between
all pairs of last roles, which chain as small matrices over the pieces of a task and then over
tasks; the cheapest route gives the roles at the cuts, between which each piece is searched by
itself. A digest of a whole conversation has to be taken in order; only its state is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch

PIECE = 256
PIECE_CHARS = 4_000_000
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3

# Last roles: none yet, system, user, assistant. An inserted or renamed row has one role it can take.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_BEFORE = {NONE: (), SYSTEM: (), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_KEEP = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ENDS = (NONE, ASSISTANT)
_LEGAL = {"su", "ua", "au"}
# Cost of the rows inserted after the last one.
_TAIL = (0, 2 * COST["I"], COST["I"], 0)
_FAR = 1 << 60

# Codes of rows: first letter of the role (x: another), in capitals if truncated; b blank, d duplicate.
_SPACE = " \t\n\x0b\x0c\r"


def code(role: str, text: str, first: bool) -> str:
    """The code of a row; ``first`` says that no earlier row has its role and text."""
    said = text.rstrip(_SPACE)
    if not said:
        return "b"
    if not first:
        return "d"
    letter = role[:1] if role[:1] in _STATE else "x"
    return letter if said[-1] in ".!?" else letter.upper()


def _steps(codes: str, i: int, state: int, inserts: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows passed, last role) of the edits that can follow."""
    if i < len(codes):
        row = codes[i]
        yield "D", COST["D"], i + 1, state
        if row not in "bd":
            more = TRUNCATED if row.isupper() else 0
            kept = _KEEP.get((row.lower(), state))
            if kept is not None:
                yield "K", COST["K"] + more, i + 1, kept
            yield "R", COST["R"] + more, i + 1, _NEXT[state]
    if i < len(codes) or inserts:
        yield "I", COST["I"], i, _NEXT[state]


def _steps_back(codes: str, i: int, state: int, inserts: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows passed, last role) of the edits that can come before."""
    if i:
        row = codes[i - 1]
        yield "D", COST["D"], i - 1, state
        if row not in "bd":
            more = TRUNCATED if row.isupper() else 0
            for before in _BEFORE[state] + ((NONE,) if state == SYSTEM else ()):
                if _KEEP.get((row.lower(), before)) == state:
                    yield "K", COST["K"] + more, i - 1, before
            for before in _BEFORE[state]:
                yield "R", COST["R"] + more, i - 1, before
    if i < len(codes) or inserts:
        for before in _BEFORE[state]:
            yield "I", COST["I"], i, before


@lru_cache(maxsize=50_000)
def search(codes: str, entry: int = NONE, exits: tuple[int, ...] = _ENDS, last: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``exits``, ties to the least audit.

    Rows can be inserted before each row, and after the final one only where ``last``; without
    it the audit ends with an edit of the final row. None where there is no way.
    """
    rows = len(codes)
    ahead = {(0, entry): (0, "")}  # node -> cost and least audit from the start
    behind = {(rows, state): (0, "", None) for state in exits}  # node -> cost, least edit, node after it
    heap, back = [(0, 0, entry)], [(0, -rows, state) for state in exits]
    done, done_back = set(), set()
    best = min((0 for node in behind if node in ahead), default=_FAR)
    while heap and back and heap[0][0] + back[0][0] <= best:
        if heap[0][0] <= back[0][0]:
            cost, i, state = heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            audit = ahead[i, state][1]
            for edit, price, j, after in _steps(codes, i, state, last):
                node, label = (j, after), (cost + price, audit + edit)
                if node not in ahead or label < ahead[node]:
                    if node not in ahead or label[0] < ahead[node][0]:
                        heappush(heap, (label[0], j, after))
                    ahead[node] = label
                if node in behind:
                    best = min(best, label[0] + behind[node][0])
        else:
            cost, i, state = heappop(back)
            i = -i
            if (i, state) in done_back:
                continue
            done_back.add((i, state))
            for edit, price, j, before in _steps_back(codes, i, state, last):
                node, label = (j, before), (cost + price, edit, (i, state))
                if node not in behind or label[:2] < behind[node][:2]:
                    if node not in behind or label[0] < behind[node][0]:
                        heappush(back, (label[0], -j, before))
                    behind[node] = label
                if node in ahead:
                    best = min(best, label[0] + ahead[node][0])
    if best == _FAR:
        return None
    found = None
    for node, (cost, audit) in ahead.items():
        if node in behind and cost + behind[node][0] == best:
            rest = []
            while behind[node][2] is not None:
                rest.append(behind[node][1])
                node = behind[node][2]
            audit += "".join(rest)
            found = audit if found is None else min(found, audit)
    return best, found


def matrix(codes: str) -> list[int]:
    """Of a piece that others follow, 16 costs (entry by exit) and 16 places of their audits."""
    costs, places = [], []
    for entry in range(4):
        found = [search(codes, entry, (state,), False) for state in range(4)]
        order = sorted(f[1] for f in found if f)
        costs += [f[0] if f else _FAR for f in found]
        places += [order.index(f[1]) if f else 4 for f in found]
    return costs + places


def chained(first: list[int], second: list[int]) -> list[int]:
    """The matrix of two pieces in a row."""
    costs, places = [], []
    for entry in range(4):
        found = []
        for state in range(4):
            ways = [(first[4 * entry + cut] + second[4 * cut + state], first[16 + 4 * entry + cut], second[16 + 4 * cut + state]) for cut in range(4)]
            found.append(min(ways))
        order = sorted(f[1:] for f in found if f[0] < _FAR)
        costs += [min(f[0], _FAR) for f in found]
        places += [order.index(f[1:]) if f[0] < _FAR else 4 for f in found]
    return costs + places


def route(matrices: list[list[int]], entry: int, tail: tuple[int, ...]) -> list[int]:
    """Last roles at all cuts of the cheapest way, ties to the least audit; ``tail`` is the cost after it."""
    choices, left = [], list(tail)
    for m in reversed(matrices):
        ways = [min((m[4 * a + b] + left[b], m[16 + 4 * a + b], b) for b in range(4)) for a in range(4)]
        choices.append([w[2] for w in ways])
        left = [min(w[0], _FAR) for w in ways]
    cuts = [entry]
    for choice in reversed(choices):
        cuts.append(choice[cuts[-1]])
    return cuts


class Conversation:
    """What a conversation's rows add up to, row by row in order."""

    def __init__(self, digest: bool):
        self.parts, self.hash = (None, hashlib.sha256()) if digest else ([], None)
        self.lines, self.audit, self.state, self.cost = 0, [], NONE, 0
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.initial = 0, None
        self.turns, self.low, self.high = 0, None, None

    def _say(self, role: str, text: str) -> None:
        self.state = _STATE[role[0]]
        if self.hash is None:
            self.parts.append(f"{role}:{text}")
        else:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, turns: list, roles: list[str], texts: list[str], codes: str, audit: str) -> None:
        i = 0
        for edit in audit:
            self.cost += COST[edit]
            if edit == "I":
                self._say(_NAMES[_NEXT[self.state]], "")
                continue
            row, role = codes[i], roles[i]
            fault = row if row in "bd" else "t" if row.isupper() else None
            if fault:
                self.faults[fault] += 1
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in _LEGAL
            self.initial = role[:1]
            turn = turns[i]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            if edit != "D":
                self.cost += TRUNCATED if fault == "t" else 0
                self._say(role if edit == "K" else _NAMES[_NEXT[self.state]], texts[i])
            i += 1
        self.audit.append(audit)

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        text = "\n".join(self.parts) if self.hash is None else self.hash.hexdigest()
        return gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), text


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
_RESULT_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_PIECE_TYPES = "part int, number int, turns array<long>, roles array<string>, texts array<string>, codes string, matrix array<long>"
_RESULT_ARROW = [pa.int64()] * 6 + [pa.string()] * 2
_PIECE_ARROW = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64())]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class _Reader:
    """Rows of one task in order; gives out results of whole conversations, and pieces of others."""

    def __init__(self, part: int, digest: bool):
        self.part, self.digest = part, digest
        self.conv, self.mark, self.begun = None, None, False
        self.open = True  # the first conversation may have begun elsewhere
        self.out: list[tuple] = []
        self._clear()
        self.number = 0

    def _clear(self) -> None:
        self.turns, self.roles, self.texts, self.codes, self.chars = [], [], [], [], 0

    def piece(self) -> None:
        if self.codes:
            codes = "".join(self.codes)
            self.out.append((self.conv, *[None] * 8, self.part, self.number, self.turns, self.roles, self.texts, codes, matrix(codes)))
            self.number += 1
            self._clear()

    def close(self) -> None:
        """The conversation ends inside the task."""
        if self.open:
            self.piece()
        elif self.codes:
            codes = "".join(self.codes)
            whole = Conversation(self.digest)
            whole.add(self.turns, self.roles, self.texts, codes, search(codes)[1])
            self.out.append((self.conv, *whole.result(), *[None] * 7))
        self._clear()

    def read(self, conv, turn, role: str, digest: bytes | None, text: str | None) -> None:
        if conv != self.conv or not self.begun:
            if self.begun:
                self.close()
                self.open = False
            self.conv, self.mark, self.number, self.begun = conv, None, 0, True
        if text is None:
            self.mark = (turn, role, digest)
            return
        row = code(role, text, self.mark == (turn, role, digest))
        if row not in "bd":
            self.mark = None
        if len(self.codes) >= PIECE or self.chars > PIECE_CHARS:
            self.open = True
            self.piece()
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(row)
        self.chars += len(text)


def _read(rows: DataFrame, digest: bool) -> DataFrame:
    """Results of the conversations that lie in one task, and the pieces of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(TaskContext.get().partitionId(), digest)
        names = ["conv_id", *_RESULT, "part", "number", "turns", "roles", "texts", "codes", "matrix"]
        types = [pa.int64(), *_RESULT_ARROW, *_PIECE_ARROW]
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                reader.read(*row)
            yield _table(reader.out, names, types)
            reader.out = []
        reader.open = True  # the last conversation may go on elsewhere
        reader.piece()
        yield _table(reader.out, names, types)

    return rows.mapInArrow(work, f"conv_id long, {_RESULT_TYPES}, {_PIECE_TYPES}")


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text): ``rows``, and before the first row of each role and
    text of a conversation a row without text."""
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    return rows.union(firsts.select("conv_id", "first.turn", "role", "digest", F.lit(None).cast("string")))


def _cuts(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, number, entry, final): the last role before every piece."""
    key = "named boolean, conv_id long, part int"

    def total(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        whole = None
        for m in group["matrix"]:
            whole = list(map(int, m)) if whole is None else chained(whole, list(map(int, m)))
        head = group.head(1)[["named", "conv_id", "part"]].copy()
        head["matrix"] = [whole]
        return head

    def between(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        cuts = route([list(map(int, m)) for m in group["matrix"]], NONE, _TAIL)
        out = group[["named", "conv_id", "part"]].copy()
        out["enters"], out["leaves"] = cuts[:-1], cuts[1:]
        out["ends"] = [False] * (len(group) - 1) + [True]
        return out

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        head = group.iloc[0]
        tail = _TAIL if head["ends"] else tuple(0 if s == head["leaves"] else _FAR for s in range(4))
        cuts = route([list(map(int, m)) for m in group["matrix"]], int(head["enters"]), tail)
        out = group[["named", "conv_id", "part", "number"]].copy()
        out["entry"], out["leaves"] = cuts[:-1], cuts[1:]
        out["final"] = [False] * (len(group) - 1) + [bool(head["ends"])]
        return out

    # A null conv_id is a conversation, too; pandas would turn it into a float.
    keyed = pieces.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "part", "number", "matrix")
    by_part = keyed.groupBy("named", "conv_id", "part")
    totals = by_part.applyInPandas(total, f"{key}, matrix array<long>")
    ways = totals.groupBy("named", "conv_id").applyInPandas(between, f"{key}, enters int, leaves int, ends boolean")
    joined = keyed.join(ways, ["named", "conv_id", "part"])
    cuts = joined.groupBy("named", "conv_id", "part").applyInPandas(within, f"{key}, number int, entry int, leaves int, final boolean")
    return cuts.select(F.when(F.col("named"), F.col("conv_id")).alias("conv_id"), "part", "number", "entry", "leaves", "final")


def _assembled(pieces: DataFrame, digest: bool) -> DataFrame:
    """Results of conversations from their pieces with entry, leaves and final."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, whole = None, None
        names, types = ["conv_id", *_RESULT], [pa.int64(), *_RESULT_ARROW]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if whole is None or row["conv_id"] != conv:
                    if whole is not None:
                        out.append((conv, *whole.result()))
                    conv, whole = row["conv_id"], Conversation(digest)
                exits = _ENDS if row["final"] else (row["leaves"],)
                found = search(row["codes"], row["entry"], exits, row["final"])
                whole.add(row["turns"], row["roles"], row["texts"], row["codes"], found[1])
            yield _table(out, names, types)
        if whole is not None:
            yield _table([(conv, *whole.result())], names, types)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(work, f"conv_id long, {_RESULT_TYPES}")


def repaired(scratch: Scratch, rows: DataFrame, digest: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) per conversation.

    ``rows`` has conv_id, turn (long), role and text; other columns are not read. Rows are taken
    by turn (nulls first), then role, then the SHA-256 of the text. ``gaps`` counts turns that are
    missing between the least and the greatest. A row's first fault counts: blank (white space
    only), duplicate (role and text occurred), truncated (doesn't end in a full stop, exclamation
    or question mark). ``illegal`` counts neighbours whose roles can't follow each other.
    ``audit`` has a letter per edit: K(eep), R(ename the role), D(elete), I(nsert an empty row).
    ``repaired`` is the lines ``role:text``, or with ``digest`` the SHA-256 of them. Null roles
    and texts are one space; an empty role can't be kept. Rows with a null conv_id are one
    conversation. Rows that repeat as a whole are duplicates. An empty table gives no row.
    """
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "digest"]
    ordered = _marked(rows).repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text").isNotNull())
    read = scratch.save(_read(ordered, digest))
    pieces = read.filter("part is not null").select("conv_id", "part", "number", "turns", "roles", "texts", "codes", "matrix")
    cuts = _cuts(pieces)
    names = [F.col(f"x.{c}") for c in ("conv_id", "part", "number", "turns", "roles", "texts", "codes")]
    same = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.number") == F.col("y.number"))
    routed = pieces.alias("x").join(cuts.alias("y"), same).select(*names, "y.entry", "y.leaves", "y.final")
    return read.filter("part is null").select("conv_id", *_RESULT).union(_assembled(routed, digest))
