import binascii
import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.llm import turns
from memlake.llm.model_queries import op13_turn_repair

LEGAL = re.compile("(s?(ua)+)?")


def every_way(kinds, truncated, most):
    """(cost, edits) of all edits up to a cost that give legal roles: by trying them."""
    found = []

    def go(i, roles, cost, edits):
        if cost > most or len(roles) > 2 * len(kinds) + 4:
            return
        if i == len(kinds) and LEGAL.fullmatch(roles):
            found.append((cost, edits))
        for role in "ua":
            go(i, roles + role, cost + 2, edits + "I")
        if i < len(kinds):
            go(i + 1, roles, cost + 3, edits + "D")
            go(i + 1, roles + " sua"[kinds[i]], cost + truncated[i], edits + "K")
            for role in "ua":
                go(i + 1, roles + role, cost + 2 + truncated[i], edits + "R")

    go(0, "", 0, "")
    return found


def plain(rows):
    """Cost and edits by a table over rows and states; rows: (kind, truncated, goes)."""
    best = {0: (0, "", [])}
    take = lambda ways: {s: min(w for t, w in ways if t == s) for s in {t for t, _ in ways}}
    name = {2: "user", 3: "assistant"}

    def inserted(best):
        ways = list(best.items())
        for _ in range(2):
            for s, (c, e, out) in list(take(ways).items()):
                t = turns.NEXT[s]
                ways.append((t, (c + 2, e + "I", [*out, name[t] + ":"])))
        return take(ways)

    for role, text, truncated, goes in rows:
        kind, ways = " sua".find(role[:1] or "-"), []
        for s, (c, e, out) in inserted(best).items():
            ways.append((s, (c + 3, e + "D", out)))
            if goes:
                continue
            if kind > 0 and turns.FOLLOWS[s][kind]:
                ways.append((kind, (c + truncated, e + "K", [*out, f"{role}:{text}"])))
            t = turns.NEXT[s]
            ways.append((t, (c + 2 + truncated, e + "R", [*out, f"{name[t]}:{text}"])))
        best = take(ways)
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def expected(rows):
    """Results by conversation from the rows (conv, turn, role, text) before any damage."""
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        fault = binascii.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        mine.extend([row] * {0: 0, 3: 2}.get(fault, 1))
    out = {}
    for conv, mine in found.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault == "truncated", fault in ("blank", "duplicate")))
        cost, edits, lines = plain(judged)
        known = {t for t, _, _ in mine if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (gaps, *faults.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


KIND, CUT = st.integers(0, 3), st.integers(0, 1)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(KIND, CUT), max_size=4))
def test_first_of_all_cheapest_edits(rows):
    kinds, cut = [k for k, _ in rows], [c for _, c in rows]
    cost, edits = turns.cheapest(kinds, cut)
    assert (cost, "".join(edits)) == min(every_way(kinds, cut, cost))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(KIND, CUT), max_size=40))
def test_longer_rows_as_a_table_has_them(rows):
    cost, edits = turns.cheapest([k for k, _ in rows], [c for _, c in rows])
    assert (cost, "".join(edits)) == plain([("xsua"[k], "t", c, False) for k, c in rows])[:2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(KIND, CUT), max_size=24), st.integers(1, 7))
def test_pieces_give_the_same_edits(rows, size):
    kinds, cut = [k for k, _ in rows], [c for _, c in rows]
    parts = [slice(i, i + size) for i in range(0, len(rows), size)]
    ahead, picked = list(turns.CLOSING), []
    for part in reversed(parts):
        ways = [
            min(((w[0] + ahead[t], w[1], t) for t in range(4) if (w := turns.cheapest(kinds[part], cut[part], s, t))))
            for s in range(4)
        ]
        ahead = [w[0] for w in ways]
        picked.append([(w[1], w[2]) for w in ways])
    state, edits = 0, []
    for ways in reversed(picked):
        edits += ways[state][0]
        state = ways[state][1]
    edits += ["I"] * (turns.CLOSING[state] // 2)
    cost, best = turns.cheapest(kinds, cut)
    assert (ahead[0], edits) == (cost, best)


def test_long_search_is_quick():
    kinds, cut = [turns.USER, turns.USER, turns.SYSTEM, turns.ASSISTANT, 0] * 80, [0, 1, 0, 0, 1] * 80
    cost, edits = turns.cheapest(kinds, cut)
    assert (cost, "".join(edits)) == plain([("xsua"[k], "t", c, False) for k, c in zip(kinds, cut)])[:2]


def odd_rows(rng, conversations=40):
    texts = ["Yes.", "Why?", "No", "", " \n", "Done!  ", None, "a.b", "ü…", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn // 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:9]


COLUMNS = "conv_id long, turn long, role string, text string"


def repaired(df):
    rows = turns.repair(turns.damaged(df)).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_rows(spark, rng):
    rows = odd_rows(rng)
    df = spark.createDataFrame(rows, COLUMNS)
    df = df.withColumns({"key": F.lit(1), "present": F.lit(False), "n": F.lit("x"), "`a.b`": F.lit(0)})
    assert repaired(df) == expected(rows)
    assert repaired(df.limit(0)) == {}


def test_long_conversations_in_pieces(spark, rng, monkeypatch):
    monkeypatch.setattr(turns, "LONG", 10)
    monkeypatch.setattr(turns, "PIECE", 4)
    rows = odd_rows(rng)
    hot = [(99, t % 150 if t % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "C!", str(t)]))
           for t in range(400)]
    # All rows of this one are dropped.
    gone = next(c for c in itertools.count(1000) if binascii.crc32(f"{c}: ".encode()) % 20 == 0)
    rows += hot + [(gone, None, "user", "A.")] * 30 + [(98, 3, "user", "A.")] * 50
    found = repaired(spark.createDataFrame(rows, COLUMNS).repartition(4))
    assert found == expected(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op13_turn_repair(spark, sf_dir)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.collect()} == expected(rows)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
