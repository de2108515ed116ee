import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from compare import SF

from rulewright.llm import queries, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
TURNS = "conv_id long, turn long, role string, text string"


def best_edits(turns):
    """All edit strings of every state, by plain enumeration: (initial, must go, cut off) to (cost, edits)."""

    def inserted(found):
        for _ in range(2):
            more = {s: set(v) for s, v in found.items()}
            for state, paths in found.items():
                for role in "ua":
                    if (to := NEXT.get((state, role))) is not None:
                        more.setdefault(to, set()).update((c + 3, a + "I") for c, a in paths if not a.endswith("II"))
            found = more
        return {s: set(sorted(v)[:80]) for s, v in found.items()}

    found = inserted({0: {(0, "")}})
    for initial, must_go, cut_off in turns:
        after = {}
        for state, paths in found.items():
            for cost, audit in paths:
                after.setdefault(state, set()).add((cost + 4, audit + "D"))
                for role, edit, paid in ((initial, "K", 0), ("u", "R", 3), ("a", "R", 3)):
                    if not must_go and (to := NEXT.get((state, role))) is not None:
                        after.setdefault(to, set()).add((cost + paid + 3 * cut_off, audit + edit))
        found = inserted(after)
    return min(x for s in (0, 3) for x in found.get(s, ()))


def plain(rows):
    """The contract's row of one conversation, from its turns after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, turns = set(), [], []
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        what = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(what)
        turns.append((role[:1], what in ("blank", "duplicate"), what == "truncated"))
    cost, audit = best_edits(turns)
    lines, todo, state = [], iter(rows), 0
    for edit in audit:
        role, text = next(todo)[1:] if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == 2 else "user"
        state = NEXT[state, role[:1]]
        lines.append(f"{role}:{text}")
    numbers = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows):
        by[conv].append(tuple(rest))
    return {c: plain(v) for c, v in by.items()}


def got(df):
    return {r["conv_id"]: {k: r[k] for k in r.asDict() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_op11_equals_brute_force(spark, sf):
    table = pq.read_table(f"{sf}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()
    assert got(queries.op11_structure_repair(spark, sf)) == expected([tuple(r.values()) for r in table])


def test_op11_edges(spark):
    rows = [
        (1, 0, "user", "a."), (1, 0, "user", "a."), (1, 5, "assistant", "b"), (1, None, "system", "c!"), (1, None, None, None),
        (None, 1, "assistant", "x."), (None, 2, "assistant", "y."), (2, 1, "tool", "z."), (2, 2, "", "q?"), (3, 9, "user", " \t\n"),
        (4, 1, "user", "long. " * 50_000), (5, None, "user", "same."), (5, None, "user", "same."), (5, 7, "user", "same."),
        *[(6, i, random.Random(i).choice(["user", "assistant", "system"]), f"t{i % 5}.") for i in range(12)],
    ]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], TURNS + ", conv string, key long")
    assert got(repair.digest(df)) == expected(rows)
    assert repair.digest(spark.createDataFrame([], TURNS)).count() == 0


def test_op11_edits_are_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "assistant", "c.")]
    edits = repair.repair(spark.createDataFrame(rows, TURNS)).orderBy("step").collect()
    assert [(r["edit"], r["was"], r["role"], r["fault"]) for r in edits] == [("K", "user", "user", None), ("I", None, "assistant", None), ("K", "user", "user", None), ("K", "assistant", "assistant", None), ("D", "assistant", None, "duplicate")]


def test_search_equals_brute_force():
    draw = random.Random(7)
    for n in range(1500):
        turns = [(draw.choice("suuaaax" if n % 2 else "uusa"), draw.random() < 0.2, draw.random() < 0.25) for _ in range(draw.randint(1, 9))]
        turns = [(i, m, c and not m) for i, m, c in turns]
        search = repair.Search()
        edits = [e for t in turns for e in search.add(*t)] + list(search.finish())
        assert "".join(e for e, _, _ in edits) == best_edits(turns)[1]
        assert [at for _, _, at in edits if at is not None] == list(range(len(turns)))


def tree(search):
    seen, todo = 0, [search.root]
    while todo:
        node = todo.pop()
        seen += 1
        todo += node.kids
    return seen


def test_search_memory_is_bounded_by_the_open_suffix():
    draw, search, most = random.Random(3), repair.Search(), 0
    for i in range(20_000):
        list(search.add(draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ("user", "assistant")[i % 2], draw.random() < 0.1, draw.random() < 0.1))
        most = max(most, tree(search))
    assert most < 400


def test_search_keeps_open_ties_whole():
    # Turns of one role only stay open to the end: either parity may win.
    for n in (999, 1000):
        search = repair.Search()
        early = [e for _ in range(n) for e in search.add("user", False, False)]
        edits = "".join(e for e, _, _ in early + list(search.finish()))
        assert edits == ("KR" * 500 if n == 1000 else "KI" + "KR" * 499)
