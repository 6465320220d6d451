"""Conversation repair against every sequence of edits, and the query against its SQL on odd rows."""

import random
import re
from itertools import product

import pytest

from reckonry.llm import op12_conversations as conv
from reckonry.plans.check import rows_of, sql_connection

PUTS = [()] + [x for n in (1, 2) for x in product("ua", repeat=n)]


def _cheapest(symbols):
    """Least (cost, audit) over all edits with at most two inserted turns in a place."""
    best = None

    def walk(at, cost, audit, initials):
        nonlocal best
        if best and cost > best[0]:
            return
        for put in PUTS:
            paid, now, word = cost + 5 * len(put), audit + "I" * len(put), initials + "".join(put)
            if at == len(symbols):
                if re.fullmatch(r"(s?(ua)+)?", word) and (best is None or (paid, now) < best):
                    best = (paid, now)
                continue
            initial, required, truncated = symbols[at]
            walk(at + 1, paid + 2, now + "D", word)
            if not required:
                more = 5 if truncated else 0
                if initial:
                    walk(at + 1, paid + more, now + "K", word + initial)
                for x in "ua":
                    walk(at + 1, paid + 1 + more, now + "R", word + x)

    walk(0, 0, "", "")
    return best


def _cost(edits, symbols):
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    return sum(price[e] + (5 if e in "KR" and symbols[t][2] else 0) for e, t, _ in edits)


def test_repair_against_every_sequence_of_edits():
    draw, repair = random.Random(3), conv.Repair()
    for _ in range(60):
        symbols = [(draw.choice(["s", "u", "a", "u", "a", ""]), draw.random() < 0.2, draw.random() < 0.25) for _ in range(draw.randrange(5))]
        edits = list(repair.backward(symbols))[::-1]
        assert (_cost(edits, symbols), "".join(e for e, *_ in edits)) == _cheapest(symbols), symbols
        roles = "".join((role or symbols[turn][0])[0] for e, turn, role in edits if e != "D")
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        assert [t for _, t, _ in edits if t is not None] == list(range(len(symbols)))


def test_another_grammar():
    """An assistant that must answer with a tool's turn in between."""
    rules = (("talk", ()), ("talk", ("talk", "u", "t", "a")))
    repair = conv.Repair(conv.Automaton(rules), (("u", "user"), ("t", "tool"), ("a", "assistant")))
    edits = list(repair.backward([("u", False, False), ("a", False, False)]))[::-1]
    assert edits in ([("D", 0, None), ("D", 1, None)],)  # cheaper than a turn put in
    edits = list(repair.backward([("u", False, False), ("u", False, False), ("a", False, False)]))[::-1]
    assert edits == [("K", 0, None), ("R", 1, "tool"), ("K", 2, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    draw, rows = random.Random(11), []
    texts = ["Yes.", "no", "", "  \n", "One. Two", "What?! ", "Ende! ", "x" * 50_000 + ".", None, "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown"]
    for c in [*range(60), None]:
        for k in range(draw.choice([1, 2, 3, 5, 9])):
            turn = draw.choice([k, k, k, None, draw.randrange(6)])
            rows.append((c, turn, draw.choice(roles), draw.choice(texts), draw.random(), "r", 0))
    rows += [(1000, k, "user" if k % 3 else "assistant", f"Turn {k % 40}." if k % 7 else "open", 0.0, "r", 0) for k in range(400)]
    rows += rows[:5]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind double, rank string, place int").write.parquet(f"{path}/conversations.parquet")
    return path


def test_query_against_its_sql(spark, odd):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{odd}/conversations.parquet/*.parquet'")
    found = conv.QUERY(spark, str(odd))
    want = con.sql(conv.SQL)
    (names, got), (wanted_names, wanted) = rows_of(found.columns, [tuple(r) for r in found.collect()]), rows_of(want.columns, want.fetchall())
    assert names == wanted_names
    assert [x for x in got if x not in wanted] == [x for x in wanted if x not in got] == []
    assert len(got) == len(wanted)


def test_repaired_turns_follow_the_grammar(spark, odd):
    marked = conv.with_faults(spark.read.parquet(f"{odd}/conversations.parquet"))
    turns = conv.repaired_turns(marked, conv.edits_of(marked)).where("edit <> 'D'").collect()
    by = {}
    for r in sorted(turns, key=lambda r: r["at"]):
        by.setdefault(r["conv_id"], []).append(r["role"][0])
    assert by and all(re.fullmatch(r"s?(ua)+", "".join(x)) for x in by.values())


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conv.QUERY(spark, str(tmp_path)).collect() == []


def test_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    found, want = conv.QUERY(spark, folder), sql_connection(folder).sql(conv.SQL)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(want.columns, want.fetchall())
