"""Repair of the turn structure of conversations at least cost, by a Viterbi search in parallel chunks.

A row is kept, given the other role, deleted, or preceded by inserted turns, so that the
role initials read ``(s?(ua)+)?``.  The search has four states (nothing yet, after s,
after u, after a); what remains to be paid from a row on is a vector of four costs.  Rows of all
conversations are sorted together by range partitioning and cut into chunks, so a
conversation of any size is many chunks and a small one is a part of one task.

1. Every chunk is swept backwards from speculative cost vectors, one a state it may end in.
2. A chunk whose results differ only by constants has converged: its costs are known up to
   a constant whatever follows.  Fix-up passes run the others on into the chunks that
   follow them, twice as far each time, until all have converged or met the true end.
3. With the cost vector of its successor stitched on, every chunk is traced forwards for each
   state it may begin in, always taking the ASCII-least of the cheapest edits; the ends of
   these traces are passed on in the same way.

All vectors are small: inserting and deleting bound how far the states can differ, so
a sweep is a walk over few remembered steps.  Only the digest of a conversation (one
letter a row and one hash over its text) is made in one task, as a stream of chunks.

Results in odd cases.  A null role or text, and a null in the key of the damage, is one space; a
null conv_id is a conversation of its own.  Rows of equal turn are taken by role and text,
equal rows stand together.  A role counts by its first character, an empty one by none;
only ``s``, ``u`` and ``a`` can be kept.  Very long texts make a chunk of their own.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common

NOTHING, S, U, A = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: What follows each state when a turn of its due role (u, u, a, u) is added.
DUE = {NOTHING: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
#: Costs at the end of a conversation: nothing and after a are complete, the others insert what lacks.
END = (0, 2 * INSERT, INSERT, 0)
#: SPREAD[k][q]: by how much q can cost more than k at most, whatever follows.  After a and after nothing all that is open after s is
#: open too, inserts lead on to u and a, a kept s is deleted instead, and an end is reached by two inserts.  So each cost
#: vector v is the minimum of SPREAD[k] + v[k], and the sweeps of these four give the sweep of any vector.
SPREAD = ((0, 4, 5, 3), (0, 0, 2, 0), (2, 2, 0, 2), (0, 4, 2, 0))
ROWS, BYTES = 1024, 1 << 16


# ---------------------------------------------------------------- damage and faults

def conv_key() -> Column:
    """conv_id as text that no null takes part in."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, n: the rows left of each conversation, equal rows in one row with their number."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select(conv_key().alias("conv"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
                                spaced("role").alias("role"), spaced("text").alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: blank, duplicate, truncated or null; of n equal rows all but the first are blank or duplicates."""
    rows = rows.withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    # one row of each text is its first; the join is on whole row keys, which are unique
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = rows.groupBy("conv", "same").agg(F.min(place).alias("place")).select(
        F.col("conv").alias("of_conv"), F.col("same").alias("of_same"), F.col("place.turn").alias("of_turn"), F.lit(True).alias("first"))
    on = (F.col("conv") == F.col("of_conv")) & (F.col("same") == F.col("of_same")) & F.col("turn").eqNullSafe(F.col("of_turn"))
    rows = rows.join(first, on, "left").select("conv", "turn", "role", "text", "n", "first")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).drop("first")


# ---------------------------------------------------------------- chunks

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def arrow(columns: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


#: One run of rows of a conversation; ``turns`` is the number of different ones, nulls apart.
CHUNK = ("conv string, range int, place long, codes array<string>, counts array<bigint>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, "
         "illegal long, first_initial string, last_initial string, turns long, first_turn long, last_turn long, least_turn long")


def code(role: str, fault: str | None) -> str:
    """What the search sees of a row: its state as a kept turn (s, u, a or -), or x if it must go; t if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    return (role[:1] if role[:1] in ("s", "u", "a") else "-") + ("t" if fault == "truncated" else "")


def legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au") and len(one) == 1


def _chunk(range_id: int, place: int, conv: str, rows: list[tuple]) -> dict:
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    illegal, before = 0, None
    for role, _, n, fault, _ in rows:
        initial = role[:1]
        illegal += (before is not None and not legal(before, initial)) + n - 1
        before = initial
        if fault:
            faults[fault] += n if fault != "truncated" else 1
        if fault in (None, "truncated"):
            # all but the first of equal rows
            faults["duplicate"] += n - 1
    turns = [t for *_, t in rows]
    known = {t for t in turns if t is not None}
    return {"conv": conv, "range": range_id, "place": place, "codes": [code(r, f) for r, _, _, f, _ in rows], "counts": [n for _, _, n, _, _ in rows],
            "roles": [r for r, *_ in rows], "texts": [t for _, t, *_ in rows], **faults, "illegal": illegal, "first_initial": rows[0][0][:1], "last_initial": before,
            "turns": len(known), "first_turn": turns[0], "last_turn": turns[-1], "least_turn": min(known, default=None)}


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range to chunks of one conversation each."""
    rows, size, conv, place, range_id, out = [], 0, None, 0, 0, []
    for batch in common.slices(batches, "text"):
        for c, r, role, text, n, fault, turn in zip(*(batch.column(k).to_pylist() for k in ("conv", "range", "role", "text", "n", "fault", "turn"))):
            if rows and (c != conv or len(rows) >= most or size >= BYTES):
                out.append(_chunk(range_id, place, conv, rows))
                rows, size, place = [], 0, place + 1
            conv, range_id = c, r
            rows.append((role, text, n, fault, turn))
            size += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow(CHUNK))
            out = []
    if rows:
        yield pa.RecordBatch.from_pylist([_chunk(range_id, place, conv, rows)], arrow(CHUNK))


def chunks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """The rows of :func:`with_faults` in order, as stored chunks of at most ``most`` rows."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    return common.store(ranged.mapInArrow(partial(_cut, most=most), CHUNK), "chunks")


# ---------------------------------------------------------------- the search inside a chunk

@lru_cache(maxsize=100_000)
def back(seen: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least, and that least."""
    extra = TRUNCATED if seen.endswith("t") else 0
    costs = [c + DELETE for c in after]
    if seen != "x":
        for q in range(4):
            costs[q] = min(costs[q], after[DUE[q]] + REROLE + extra)
            if (kept := keep(seen, q)) is not None:
                costs[q] = min(costs[q], after[kept] + extra)
    for _ in range(2):
        costs = [min(c, costs[DUE[q]] + INSERT) for q, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


def keep(seen: str, q: int) -> int | None:
    """The state after a row that is kept in state q, if it can be."""
    role = seen[0]
    if role == "s":
        return S if q == NOTHING else None
    due = DUE[q]
    return due if {"u": U, "a": A}.get(role) == due else None


@lru_cache(maxsize=100_000)
def moves(seen: str, after: tuple[int, ...], q: int) -> tuple[str, int, int]:
    """The ASCII-least of the cheapest edits up to and with one row: letters, state and cost."""
    letters, cost = "", 0
    while True:
        before, least = back(seen, after)
        rest = before[q] + least
        extra = TRUNCATED if seen.endswith("t") else 0
        if after[q] + DELETE == rest:
            return letters + "D", q, cost + DELETE
        if before[DUE[q]] + least + INSERT == rest:
            letters, q, cost = letters + "I", DUE[q], cost + INSERT
        elif (kept := keep(seen, q)) is not None and after[kept] + extra == rest:
            return letters + "K", kept, cost + extra
        else:
            return letters + "R", DUE[q], cost + REROLE + extra


def sweep(codes: list[str], counts: list[int], after: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """The cost vectors after every row of a chunk, then the one before it, last first; and what was taken from them in all."""
    vectors, taken = [after], 0
    for seen, n in zip(reversed(codes), reversed(counts)):
        after, least = back(seen, after)
        # all but the first of equal rows are deleted in every state
        taken += least + (n - 1) * DELETE
        vectors.append(after)
    return vectors, taken


def trace(codes: list[str], counts: list[int], vectors: list[tuple[int, ...]], q: int) -> tuple[str, int, int]:
    """Edits, end state and cost of a chunk from its begin state; ``vectors`` as :func:`sweep` gives them."""
    letters, cost = [], 0
    for k, (seen, n) in enumerate(zip(codes, counts)):
        made, q, paid = moves(seen, vectors[len(codes) - 1 - k], q)
        letters.append(made + "D" * (n - 1))
        cost += paid + DELETE * (n - 1)
    return "".join(letters), q, cost


def at_end(q: int) -> tuple[str, int]:
    """Edits and cost of closing a conversation in state q."""
    return {NOTHING: ("", 0), S: ("II", 2 * INSERT), U: ("I", INSERT), A: ("", 0)}[q]


# ---------------------------------------------------------------- passes over chunks

def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """costs: 16 numbers, [4 * q + k] from state q before the chunk if SPREAD[k] stands behind it."""
    for batch in batches:
        made = []
        for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
            ends = []
            for after in SPREAD:
                vectors, taken = sweep(codes, counts, after)
                ends.append([c + taken for c in vectors[-1]])
            made.append([ends[k][q] for q in range(4) for k in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, pa.list_(pa.int64()))], [*batch.schema.names[2:], "costs"])


def _settle(rows: DataFrame, value: str, follow: Column, toward: int) -> DataFrame:
    """Run the chunks whose ``value`` is not settled on into those that follow (toward 1) or precede them (-1), twice as far in each pass."""
    rows = common.store(rows.withColumn("at", F.col("idx") + toward), "pass")
    while rows.where("not settled").limit(1).count():
        on = rows.select("conv", F.col("idx").alias("at"), F.col(value).alias("other"), F.col("at").alias("further"), F.col("settled").alias("known"))
        open_rows = rows.where("not settled").join(on, ["conv", "at"]).withColumn(value, follow)
        open_rows = open_rows.select(*[F.col("further").alias("at") if c == "at" else constant(value).alias("settled") if c == "settled" else c for c in rows.columns])
        rows = common.store(rows.where("settled").unionByName(open_rows), "pass")
    return rows


def constant(value: str) -> Column:
    """Whether all four columns of costs differ only by constants, or all four ends are the same."""
    at = lambda k: F.col(value)[k]
    if value == "ends":
        return (at(0) == at(1)) & (at(0) == at(2)) & (at(0) == at(3))
    parallel = F.lit(True)
    for q in range(1, 4):
        for k in range(1, 4):
            parallel &= at(4 * q + k) - at(k) == at(4 * q) - at(0)
    return parallel


def numbered(made: DataFrame) -> DataFrame:
    """Chunks without their rows, numbered in each conversation, with their speculative costs and what their borders add."""
    light = made.select("codes", "counts", "conv", "range", "place", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns", "first_turn", "last_turn", "least_turn")
    kept = light.drop("codes", "counts").schema.add("costs", ArrayType(LongType()))
    order = Window.partitionBy("conv").orderBy("range", "place")  # one row a chunk
    rows = light.mapInArrow(_speculate, kept).select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.lead("place").over(order).isNull().alias("last"),
        F.lag("last_initial").over(order).alias("before"), F.lag("last_turn").over(order).alias("turn_before"))
    pair = F.concat("before", "first_initial")
    legal_pair = (F.length("before") == 1) & pair.isin("su", "ua", "au")
    return rows.select(
        "conv", "range", "place", "idx", "last", "costs", "blank", "duplicate", "truncated",
        (F.col("illegal") + F.when(F.col("before").isNull() | legal_pair, 0).otherwise(1)).alias("illegal"),
        (F.col("turns") - F.when(F.col("turn_before") == F.col("first_turn"), 1).otherwise(0)).alias("turns"), "last_turn", "least_turn")


def stitched(rows: DataFrame) -> DataFrame:
    """Adds ``after``: the cost vector behind every chunk, up to a constant."""
    cost = lambda q, k: F.col("costs")[4 * q + k]
    ended = F.array(*[F.least(*[cost(q, k) + END[k] for k in range(4)]) for q in range(4) for _ in range(4)])
    rows = rows.select("conv", "idx", "last", F.when(F.col("last"), ended).otherwise(F.col("costs")).alias("costs"))
    rows = rows.withColumn("settled", constant("costs"))
    product = F.array(*[F.least(*[cost(q, j) + F.col("other")[4 * j + k] for j in range(4)]) for q in range(4) for k in range(4)])
    settled = _settle(rows, "costs", product, 1)
    vector = F.array(*[cost(q, 0) for q in range(4)])
    return settled.where("idx > 0").select("conv", (F.col("idx") - 1).alias("idx"), F.transform(vector, lambda c: c - F.array_min(vector)).alias("after"))


TRACED = "conv string, range int, place long, idx long, last boolean, ends array<bigint>, costs array<bigint>, edits array<string>"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends, costs and edits of a chunk for each of the four states it may begin in; a first chunk begins in one."""
    for batch in batches:
        made = []
        for codes, counts, after, idx in zip(*(batch.column(c).to_pylist() for c in ("codes", "counts", "after", "idx"))):
            vectors, _ = sweep(codes, counts, tuple(after) if after else END)
            traces = [trace(codes, counts, vectors, q) for q in (range(4) if idx else (NOTHING,))]
            made.append(traces if idx else traces * 4)
        schema = arrow(TRACED)
        fixed = [batch.column(c) for c in ("conv", "range", "place", "idx", "last")]
        yield pa.RecordBatch.from_arrays([*fixed, *(pa.array([[t[k] for t in traces] for traces in made], schema.field(c).type) for c, k in (("ends", 1), ("costs", 2), ("edits", 0)))], schema=schema)


REPAIRED = "conv string, idx long, cost long, edits string, roles array<string>, texts array<string>"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every chunk from the state it does begin in, and the turns they leave."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            edits, cost = r["edits"][r["begin"]], r["costs"][r["begin"]]
            if r["last"]:
                more, paid = at_end(r["ends"][r["begin"]])
                edits, cost = edits + more, cost + paid
            rows = ((role, text) for role, text, n in zip(r["roles"], r["texts"], r["counts"]) for _ in range(n))
            q, roles, texts = r["begin"], [], []
            for letter in edits:
                role, text = next(rows) if letter != "I" else (None, "")
                if letter == "D":
                    continue
                q = {"s": S, "u": U, "a": A}[role[0]] if letter == "K" else DUE[q]
                roles.append(role if letter == "K" else ROLE[q])
                texts.append(text)
            out.append({"conv": r["conv"], "idx": r["idx"], "cost": cost, "edits": edits, "roles": roles, "texts": texts})
        yield pa.RecordBatch.from_pylist(out, arrow(REPAIRED))


def repaired(made: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, idx, cost, edits, roles, texts: what is left of every chunk of :func:`chunks`; ``rows`` are they :func:`numbered`."""
    after = rows.select("conv", "range", "place", "idx", "last").join(stitched(rows), ["conv", "idx"], "left")
    traced = common.store(made.select("conv", "range", "place", "codes", "counts").join(after, ["conv", "range", "place"]).select(
        "conv", "range", "place", "idx", "last", "codes", "counts", "after").mapInArrow(_trace, TRACED), "traced")
    ends = traced.select("conv", "idx", "ends").withColumn("settled", constant("ends"))
    through = F.transform("other", lambda q: F.col("ends")[q.cast("int")])
    begin = _settle(ends, "ends", through, -1).select("conv", (F.col("idx") + 1).alias("idx"), F.col("ends")[0].alias("begin"))
    begun = traced.join(begin, ["conv", "idx"], "left").withColumn("begin", F.coalesce("begin", F.lit(NOTHING).cast("long")))
    return begun.join(made.select("conv", "range", "place", "counts", "roles", "texts"), ["conv", "range", "place"]).drop("range", "place").mapInArrow(_apply, REPAIRED)


def turns(left: DataFrame) -> DataFrame:
    """One row a repaired turn: conv, idx (of its chunk), place in it, role, text."""
    return left.select("conv", "idx", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select("conv", "idx", "place", "turn.roles", "turn.texts").toDF(
        "conv", "idx", "place", "role", "text")


DIGEST = "conv string, cost long, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row a conversation; text is hashed as it passes."""
    schema = arrow(DIGEST)
    conv, out = None, []

    def finish():
        out.append({"conv": conv, "cost": cost, "audit": "".join(edits), "repaired_sha256": state.hexdigest()})

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    finish()
                conv, cost, edits, state, begun = r["conv"], 0, [], hashlib.sha256(), False
            cost += r["cost"]
            edits.append(r["edits"])
            for role, text in zip(r["roles"], r["texts"]):
                state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if conv is not None:
        finish()
        yield pa.RecordBatch.from_pylist(out, schema)


def audit(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """Faults, cost, least audit and digest of every conversation of (conv_id, turn, role, text) after its damage."""
    made = chunks(with_faults(damaged(conversations)), most)
    rows = common.store(numbered(made), "numbered")
    left = repaired(made, rows)
    digests = left.repartition("conv").sortWithinPartitions("conv", "idx").mapInArrow(_digest, DIGEST)
    sums = rows.groupBy("conv").agg(
        (F.max("last_turn") - F.min("least_turn") + 1 - F.sum("turns")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    every = conversations.select("conv_id", conv_key().alias("conv")).distinct()
    zero = F.lit(0).cast("long")
    return every.join(sums, "conv", "left").join(digests, "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same search forwards, a row at a time, in DuckDB: each state holds its cheapest edits, the ASCII-least of them, and the turns they leave."""
    least = lambda *x: f"list_aggregate([{', '.join(x)}], 'min')"
    def then(x, letter, paid, turn):
        return f"{{'c': {x}.c + {paid}, 'e': {x}.e || '{letter}', 't': {f'list_append({x}.t, {turn})' if turn else f'{x}.t'}}}"
    insert = lambda x, role: then(x, "I", INSERT, f"'{role}:'")
    inserted = f"""SELECT *, {least('i2', insert('s3', 'user'))} AS j2 FROM (SELECT *, {least('s2', insert('s0', 'user'), insert('s1', 'user'))} AS i2 FROM %s)"""
    closed_to = lambda source: f"(SELECT *, {least('s3', insert('j2', 'assistant'))} AS j3 FROM ({inserted % source}))"
    lost = "{'c': 1000000000, 'e': '', 't': CAST([] AS VARCHAR[])}"
    go = lambda ok, x: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND {ok} THEN {x} ELSE {lost} END"
    extra = "(fault = 'truncated')::int"
    kept = lambda x, initial: go(f"role[1] = '{initial}'", then(x, "K", extra, "role || ':' || text"))
    other = lambda x, role: go("true", then(x, "R", f"{REROLE} + {extra}", f"'{role}:' || text"))
    gone = lambda x: then(x, "D", DELETE, None)
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
crcs AS (SELECT DISTINCT k, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(k::blob)), lambda b: ascii(k[b + 1])::bigint)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))) AS raw FROM src),
kinds AS (SELECT k, xor(raw, 4294967295) % 20 AS kind FROM crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src JOIN kinds USING (k), range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
rows AS (
  SELECT conv_id, turn, i, role, text, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND (before[1] || role[1] NOT IN ('su', 'ua', 'au') OR length(before[1]) = 0)) AS illegal,
         count(*) AS n FROM rows GROUP BY 1),
walk AS (
  SELECT conv_id, 0::bigint AS i, {{'c': 0, 'e': '', 't': CAST([] AS VARCHAR[])}} AS s0, {lost} AS s1, {lost} AS s2, {lost} AS s3 FROM sums
  UNION ALL
  SELECT conv_id, i, {gone('s0')}, {least(gone('s1'), kept('s0', 's'))},
         {least(gone('j2'), *[f(x, v) for x in ('s0', 's1', 'j3') for f, v in ((kept, 'u'), (other, 'user'))])},
         {least(gone('j3'), kept('j2', 'a'), other('j2', 'assistant'))}
  FROM {closed_to("(SELECT w.conv_id, r.i, r.role, r.text, r.fault, w.s0, w.s1, w.s2, w.s3 FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)")}),
ends AS (
  SELECT conv_id, {least('s0', 'j3')} AS best
  FROM {closed_to("(SELECT w.* FROM walk w JOIN sums s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n)")})
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0)::bigint AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
