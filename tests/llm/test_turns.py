"""Turn repair against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from colloquy.llm import turn_repair as tr
from tools.check import rows_of

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by a search forwards that keeps the least edits of every state."""
    best = {"": (0, "", ())}

    def insert(states):
        for _ in range(2):
            for q, (cost, edits, lines) in list(states.items()):
                role = "assistant" if q == "u" else "user"
                new = (cost + 2, edits + "I", lines + (role + ":",))
                states[role[0]] = min(states.get(role[0], new), new)
        return states

    for role, text, fault in rows:
        after, more = {}, fault == "truncated"
        for q, (cost, edits, lines) in insert(best).items():
            due = "assistant" if q == "u" else "user"
            options = [(q, (cost + 3, edits + "D", lines))]
            if fault not in ("blank", "duplicate"):
                if role[:1] == due[0] or (role[:1] == "s" and q == ""):
                    options.append((role[:1], (cost + more, edits + "K", lines + (f"{role}:{text}",))))
                options.append((due[0], (cost + 2 + more, edits + "R", lines + (f"{due}:{text}",))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        best = after
    best = insert(best)
    return min(v for q, v in best.items() if q in ("", "a"))


def plain(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text, *_ in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [r[0] for r in rows if r[0] is not None]
        faults = [m[2] for m in marked]
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(marked, marked[1:]))
        cost, edits, lines = cheapest(marked)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def some_table():
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \n", "Why? ", "a!b", "...", None, "x" * 30_000 + ".", "é ", "Good. " + " " * 50_000 + "q"]
    table = [(c, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]), rng.choice(texts) or f"Turn {i}{rng.choice(['.', ''])}", 1, "r")
             for c in range(60) for i in range(rng.randrange(1, 14))]
    # parities that reach over many chunks, blanks that settle nothing, copies, gaps, nulls
    table += [(100, i, "user", f"Same role {i}.", 1, "r") for i in range(90)] + [(101, i, "tool", f"No role {i}.", 1, "r") for i in range(75)]
    table += [(102, i, "user", "", 1, "r") for i in range(40)] + [(102, 50, "assistant", "End.", 1, "r")]
    table += [(103, i, "system", f"Sys {i}.", 1, "r") for i in range(33)] + [(104, 7, "user", "Same.", 1, "r")] * 50 + [(104, 1, "user", "Same.", 1, "r"), (104, -5, "assistant", "Same.", 1, "r")]
    table += [(105, None, "user", "Hi.", 1, "r"), (105, None, "user", "Hi.", 1, "r"), (105, None, None, "Ho.", 1, "r"), (106, None, "user", None, 1, "r")]
    table += [(None, i, ["user", "assistant"][i % 2], f"Null {i}.", 1, "r") for i in range(25)] + [(107, i * 1000, ["user", "assistant"][i % 2], f"T {i}.", 1, "r") for i in range(60)]
    dropped = next(t for t in range(500) if zlib.crc32(f"108:{t}".encode()) % 20 == 0)
    return table + [(108, dropped, "user", "Gone.", 1, "r")]


KEY = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("most", [1, 3, tr.ROWS])
def test_chunks_of_any_size_agree_with_a_plain_search(spark, most):
    table = some_table()
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, idx int, range string")
    got = tr.audit(df.repartition(5), most)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == sorted(plain(table), key=KEY)


def test_sql_agrees_with_the_plain_search(spark):
    table = [r for r in some_table() if r[0] is None or r[0] < 20 or r[0] > 102]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(table, "conv_id long, turn long, role string, text string, idx int, range string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cur = con.execute(tr.ORACLE)
    assert rows_of([d[0] for d in cur.description], cur.fetchall()) == rows_of(COLUMNS, plain(table))


def test_no_conversation(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tr.audit(df).count() == 0


def test_turns_that_are_left(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hello."), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    made = tr.chunks(tr.with_faults(tr.damaged(df)))
    left = tr.turns(tr.repaired(made, tr.numbered(made))).orderBy("conv", "idx", "place").collect()
    roles = [r["role"] for r in left]
    assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
    assert set(r["text"] for r in left) <= {"Hello.", "Again.", "Yes.", "Hello", "Again", "Yes", ""}


def test_cost_vectors_stay_within_their_spread():
    rng = random.Random(1)
    codes = ["x", *("".join(p) for p in product("sua-", ["", "t"]))]
    for _ in range(300):
        after, _ = tr.sweep([rng.choice(codes) for _ in range(rng.randrange(12))], [1] * 12, tr.END)
        v = after[-1]
        assert all(v[q] <= v[k] + tr.SPREAD[k][q] for q in range(4) for k in range(4))


def test_given_conversations(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    table = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    got = tr.audit(spark.read.parquet(path), 2)
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == sorted(plain(table), key=KEY)
