"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

Turns of a conversation are read in order, and every turn is kept, given another
role or deleted; turns without text may be inserted. The cheapest edits win that
give the role initials ``(s?(ua)+)?``; of several, the one whose initials of edits
are least as a string. A search state is how far that pattern has come; each
state has one survivor, the best edits so far that lead to it.

The edits of all survivors form a tree of back pointers. A node counts its
references (children, and a survivor that ends there) and is freed with the last
one. While the oldest node has a single child, all survivors share it: its edit is
certain and leaves the tree at once. So memory holds the unresolved suffixes
only, not the conversation. Two survivors that tie in cost are told apart by their
whole unresolved suffixes: both edit the same turns and end in an edit of a turn, so
neither is the beginning of the other, and their order at the first difference
stays; it is carried along as a rank instead of being read again.

Spark finds the first occurrence of each turn's role and text (a grouped minimum,
combined before the shuffle), brings the turns of a conversation together in order
by a shuffle and a sort that spills, and streams them through the search. One
conversation is one stream, however long: edits depend on all turns before.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Rows of an output batch.
_BATCH = 4096

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a turn of a role initial, where the pattern allows it.
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
#: The turn that may come next besides a system turn.
_WANTED = {_START: "user", _SYSTEM: "user", _USER: "assistant", _ASSISTANT: "user"}
#: What completes the pattern at the end.
_CLOSING = {_START: (), _SYSTEM: ("user", "assistant"), _USER: ("assistant",), _ASSISTANT: ()}
#: (worse state, better state, the most that the better one pays more from there on): after an assistant turn all that a later state
#: does can be done too, a kept system turn by deleting it, a missing turn by inserting it.
_COVERED = ((_SYSTEM, _ASSISTANT, 0), (_START, _ASSISTANT, DELETE), (_USER, _ASSISTANT, INSERT), (_ASSISTANT, _USER, INSERT))


class _Node:
    """One edit; ``turn`` is the place of its turn in the conversation, None for an inserted one."""

    __slots__ = ("parent", "edit", "role", "turn", "refs", "kids")

    def __init__(self, parent: _Node | None, edit: str, role: str | None, turn: int | None) -> None:
        self.parent, self.edit, self.role, self.turn, self.refs, self.kids = parent, edit, role, turn, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


def _free(node: _Node) -> None:
    while node.refs == 0 and node.parent is not None:
        parent = node.parent
        parent.refs -= 1
        parent.kids.remove(node)
        node.parent, node = None, parent


class Search:
    """The search over one conversation; ``add`` and ``finish`` give the edits that have become certain as (edit, role, turn)."""

    def __init__(self) -> None:
        self.root = _Node(None, "", None, None)
        self.root.refs = 1
        self.live = {_START: (0, 0, self.root)}
        self.turn = 0

    def add(self, role: str, must_go: bool, cut_off: bool) -> Iterator[tuple[str, str | None, int | None]]:
        found: dict[int, tuple] = {}
        extra, initial = CUT_OFF if cut_off else 0, role[:1]

        def offer(state: int, cost: int, rank: int, tail: str, role: str | None, node: _Node, inserted: str | None) -> None:
            key = (cost, rank, tail)
            if state not in found or key < found[state][0]:
                found[state] = (key, role, node, inserted)

        for state, (cost, rank, node) in self.live.items():
            offer(state, cost + DELETE, rank, "D", None, node, None)
            if must_go:
                continue
            for at, inserted, paid in ((state, None, 0), (_NEXT[state, _WANTED[state][0]], _WANTED[state], INSERT)):
                mark = "I" if inserted else ""
                if (to := _NEXT.get((at, initial))) is not None:
                    offer(to, cost + paid + extra, rank, mark + "K", role, node, inserted)
                offer(_NEXT[at, _WANTED[at][0]], cost + paid + REROLE + extra, rank, mark + "R", _WANTED[at], node, inserted)
        order = sorted(found, key=lambda s: found[s][0][1:])
        rank = {s: i for i, s in enumerate(order)}
        for worse, better, more in _COVERED:
            if worse in found and better in found and (found[better][0][0] + more, rank[better]) < (found[worse][0][0], rank[worse]):
                del found[worse]
        old, self.live = self.live, {}
        for state, ((cost, _, tail), out, node, inserted) in found.items():
            if inserted:
                node = _Node(node, "I", inserted, None)
            node = _Node(node, tail[-1], out, self.turn)
            node.refs += 1
            self.live[state] = (cost, rank[state], node)
        for _, _, node in old.values():
            node.refs -= 1
            _free(node)
        self.turn += 1
        yield from self._certain()

    def _certain(self) -> Iterator[tuple[str, str | None, int | None]]:
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.edit, self.root.role, self.root.turn

    def finish(self) -> Iterator[tuple[str, str | None, int | None]]:
        state = min(self.live, key=lambda s: (self.live[s][0] + INSERT * len(_CLOSING[s]), self.live[s][1]))
        node, path = self.live[state][2], []
        while node is not self.root:
            path.append((node.edit, node.role, node.turn))
            node = node.parent
        yield from reversed(path)
        for role in _CLOSING[state]:
            yield "I", role, None


def fault(text: str, repeated: bool) -> str | None:
    """The first fault of a turn: blank, duplicate or truncated."""
    said = text.rstrip(_SPACES)
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return None if said[-1] in ".!?" else "truncated"


def _first_turns(turns: DataFrame) -> DataFrame:
    """Mark the turns at which their role and text occur first in the conversation."""
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    keyed = turns.withColumn("key", key)
    first = keyed.groupBy(F.col("conv").alias("of"), F.col("key").alias("same")).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("early"))
    met = keyed.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same")))
    return met.select("conv", "turn", "role", "text", F.when(F.col("early"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least")).alias("first"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Edits of every conversation, one row each: ``conv_id, step, edit, turn, was, role, text, fault``.

    ``edit`` is K (kept), R (new role), D (deleted) or I (inserted). ``was`` and
    ``role`` are the role before and after (null where there is none), ``fault`` is
    the first of blank, duplicate (role and text came before) and truncated (the text
    does not end in ``.``, ``!`` or ``?``). Rows of a conversation adjoin, in order.

    Turns go by number, null first; turns of one number by role and text. A null
    role or text is one space; a null conversation is a conversation. Equal rows are
    turns that repeat. Only roles that begin with s, u or a can be kept. An empty table
    gives no rows; a conversation without any edit cannot occur. Memory is that of
    the turns whose edits are not certain yet.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), _space(role_col).alias("role"), _space(text_col).alias("text"))
    kind = own.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    schema = f"conv {kind}, step long, edit string, turn long, was string, role string, text string, fault string"
    return _first_turns(own).repartition("conv").sortWithinPartitions(*order).mapInArrow(_edited, schema).withColumnRenamed("conv", conv_col)


def _space(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conversation, turn, role, text, first) to rows of edits."""
    out: list[tuple] = []
    conv, search, waiting, before, step = None, None, deque(), None, 0
    kind = pa.null()

    def note(edits: Iterator[tuple[str, str | None, int | None]]) -> None:
        nonlocal step
        for edit, role, at in edits:
            turn, was, text, what = (None, None, "", None) if at is None else waiting.popleft()
            out.append((conv, step, edit, turn, was, role, text, what))
            step += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv", "step", "edit", "turn", "was", "role", "text", "fault"])

    for rows in batches:
        kind = rows.schema.field(0).type
        for of, turn, role, text, first in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if search is None or of != conv:
                if search is not None:
                    note(search.finish())
                conv, search, before, step = of, Search(), None, 0
            what = fault(text, not first or before == (turn, role, text))
            before = (turn, role, text)
            waiting.append((turn, role, text, what))
            note(search.add(role, what in ("blank", "duplicate"), what == "truncated"))
            if len(out) >= _BATCH:
                yield batch()
    if search is not None:
        note(search.finish())
    if out:
        yield batch()


def summary(edits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of the rows of ``repair``, as that returns them (nothing between that moves rows).

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``: missing turn numbers, turns by first fault, neighbours whose
    role initials are not su, ua or au, the cost and the initials of the edits, and
    the hash of the repaired lines ``role:text``. Sums and the hash grow with each
    row; only the initials of a conversation are held.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, one = None, None
        for rows in batches:
            done = []
            for of, step, *rest in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if one is None or step == 0:
                    if one is not None:
                        done.append((conv, *one.row()))
                    conv, one = of, _Sums()
                one.add(*rest)
            if done:
                yield _sum_rows(done, rows.schema.field(0).type)
        if one is not None:
            yield _sum_rows([(conv, *one.row())], rows.schema.field(0).type)

    kind = edits.schema[conv_col].dataType.simpleString()
    fields = edits.select(F.col(conv_col).alias("conv"), "step", "edit", "turn", "was", "role", "text", "fault")
    return fields.mapInArrow(count, f"conv {kind}, " + ", ".join(f"{n} long" for n in _COUNTS) + ", audit string, repaired_sha256 string").withColumnRenamed("conv", conv_col)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class _Sums:
    """The sums of one conversation."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.least = self.most = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.lines = 0

    def add(self, edit: str, turn: int | None, was: str | None, role: str | None, text: str, what: str | None) -> None:
        self.audit.append(edit)
        self.cost += _COSTS[edit] + (CUT_OFF if what == "truncated" and edit != "D" else 0)
        if what:
            self.faults[what] += 1
        if edit != "I":
            if self.before is not None and self.before[:1] + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.most
                self.most = turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _sum_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", *_COUNTS, "audit", "repaired_sha256"])


def damage(turns: DataFrame) -> DataFrame:
    """Turns of ``conversations`` with faults planted by a hash of conversation and turn: dropped, emptied, without sentence ends, repeated, spoken by the user."""
    kind = F.crc32(F.concat(_space_of("conv_id"), F.lit(":"), _space_of("turn")).cast("binary")) % 20
    own = turns.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _space_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def digest(turns: DataFrame) -> DataFrame:
    """Damage ``conversations``, repair them, and sum up every conversation; one that lost all its turns has zeros, no edits and the hash of nothing."""
    sums = summary(repair(damage(turns))).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct()
    met = every.join(sums, every["conv_id"].eqNullSafe(sums["of"]), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
