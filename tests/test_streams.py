import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.operators import sequences as E
from colloquy.streaming import streams as J


def _events(spark, n=300):
    rng = random.Random(4)
    t, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([1, 2, 5, 30]))
        rows.append((rng.choice("ab"), i, t))
    return spark.createDataFrame(rows, "k string, i long, ts timestamp")


def plain_chunks(rows, gap, low, high):
    out, start, last = [], None, None
    for r in rows:
        t = r.ts.timestamp()
        if start is None or t - start >= high or (t - last >= gap and t - start >= low):
            start = t
        out.append((r.i, start))
        last = t
    return out


def test_chunks_match_the_plain_loop(spark):
    df = _events(spark)
    got = {r.i: r.chunk_start / 1e6 for r in E.pause_chunks(df, "k", "ts", "i", 10, 20, 60).collect()}
    for k in "ab":
        rows = df.filter(F.col("k") == k).orderBy("ts", "i").collect()
        for i, start in plain_chunks(rows, 10, 20, 60):
            assert abs(got[i] - start) < 1e-3


def chunk_rows(df):
    """Chunks of the batch operator as (key, first, last, rows), times in whole seconds."""
    rows = E.pause_chunks(df, "k", "ts", "i", 10, 20, 60).groupBy("k", "chunk_start").agg(F.max("ts").alias("last"), F.count("*").alias("rows"))
    return sorted((r.k, r.chunk_start // 1000000, int(r.last.timestamp()), r.rows) for r in rows.collect())


def streamed(spark, schema, base):
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    chunks = J.bounded_chunks(stream, "k", "ts", 10, 20, 60, watermark="90 seconds", ended="ended")
    J.start_chunks(chunks, f"{base}/cp", f"{base}/out", once=True).awaitTermination()
    return sorted((r.key, int(r.chunk_start.timestamp()), int(r.last_row.timestamp()), r.rows) for r in spark.read.parquet(f"{base}/out").collect())


def test_streamed_chunks_equal_the_batch_over_batches_out_of_order(spark, tmp_path):
    rows = sorted(_events(spark).collect(), key=lambda r: (r.ts + dt.timedelta(seconds=r.i * 37 % 60), r.i))  # up to a minute late
    want, schema = chunk_rows(_events(spark)), "k string, i long, ts timestamp, ended boolean"
    stops = [(k, None, max(r.ts for r in rows if r.k == k), True) for k in "ab"]
    for part in ([(*r, False) for r in rows[:110]], [(*r, None) for r in rows[110:210]], [(*r, False) for r in rows[210:]] + stops):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = streamed(spark, schema, tmp_path)
        assert set(got) <= set(want)
    assert got == want


def test_a_key_that_never_stops_waits_for_the_longest_chunk(spark, tmp_path):
    schema, t = "k string, i long, ts timestamp, ended boolean", dt.datetime(2024, 1, 1)
    at = lambda *s: [("a", i, t + dt.timedelta(seconds=x), False) for i, x in enumerate(s)]
    spark.createDataFrame(at(0, 5, 9), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert streamed(spark, schema, tmp_path) == []
    spark.createDataFrame([("b", 0, t + dt.timedelta(seconds=300), False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert [(k, rows) for k, _, _, rows in streamed(spark, schema, tmp_path)] == [("a", 3)]


def test_relabel_uses_turns_of_all_batches(spark, tmp_path):
    seg = spark.createDataFrame([("m", 0, "S", "t", 0.0, 1.0), ("m", 1, "S", "t", 1.0, 2.0)],
                                "meeting_id string, segment_index int, speaker string, text string, start_time double, end_time double")
    seg.write.parquet(str(tmp_path / "seg"))
    schema = "meeting_id string, turn_idx int, speaker string, start_time double, end_time double"
    for i, row in enumerate([("m", 0, "A", 0.0, 1.0), ("m", 1, "B", 1.0, 2.0)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "turns"))
        J.start_relabel(stream, str(tmp_path / "seg"), str(tmp_path / "cp"), str(tmp_path / "out"), once=True).awaitTermination()
    got = {r.segment_index: r.speaker for r in spark.read.parquet(str(tmp_path / "out/segments")).collect()}
    assert got == {0: "A", 1: "B"}


def test_status_keeps_progress_only_within_a_stage(spark):
    rows = [("m", 1, "queued", 0.1), ("m", 2, "transcribing", 0.4), ("m", 3, "transcribing", None), ("n", 1, "queued", 0.5), ("n", 2, "done", None)]
    df = spark.createDataFrame([(m, i, dt.datetime(2024, 1, 1, 0, 0, i), s, p) for m, i, s, p in rows],
                               "meeting_id string, event_id long, event_time timestamp, status string, progress double")
    got = {r.meeting_id: (r.status, r.progress, r.finished) for r in J.latest_status(df).collect()}
    assert got == {"m": ("transcribing", 0.4, False), "n": ("done", None, True)}


def test_tail_shows_every_row_once_over_two_deliveries(spark, tmp_path):
    schema = "segment_id string, event_time timestamp"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "segment_id string").withColumn("event_time", F.timestamp_seconds(F.lit(1704067200)))
    source, stored = tmp_path / "in", rows("s0").select("segment_id")
    for ids in (("s0", "s1", "s2"), ("s1", "s2", "s3", "s3")):
        rows(*ids).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        J.start_tail(stored, stream, str(tmp_path / "check"), str(tmp_path / "out"), once=True).awaitTermination()
    got = sorted((r.segment_id, r.live) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s0", False), ("s1", True), ("s2", True), ("s3", True)]


def test_status_state_holds_open_meetings_only(spark, tmp_path):
    schema, t = "meeting_id string, event_id long, event_time timestamp, status string, progress double", dt.datetime(2024, 1, 1)
    batches = [
        [("m", 1, 0, "queued", 0.1), ("n", 2, 1, "queued", None), ("o", 3, 2, "transcribing", 0.2), ("n", 4, 3, "done", 1.0)],
        [("o", 5, 200, "transcribing", None), ("m", 6, 190, "structuring", 0.6), ("m", 7, 195, "structuring", None), ("x", 8, 201, "unheard", 0.5), ("p", 9, None, "queued", 0.5)],
        [("o", 10, 400, "error", None), ("n", 11, 401, "queued", None)],  # n begins again after its state has gone
        [("z", 12, 900, "queued", None), ("o", 13, 3, "queued", 0.9)],  # the second is too late
    ]
    open_after, kept = [], {}
    for rows in batches:
        told = [(m, i, None if s is None else t + dt.timedelta(seconds=s), st, p) for m, i, s, st, p in rows]
        spark.createDataFrame(told, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = J.start_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", f"{tmp_path}/out", once=True)
        q.awaitTermination()
        open_after.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = J.newest_versions(spark.read.parquet(f"{tmp_path}/out"))
    kept = {r.meeting_id: (r.status, r.progress, r.finished) for r in got.collect()}
    assert kept == {"m": ("structuring", 0.6, False), "n": ("queued", None, False), "o": ("error", None, True), "z": ("queued", None, False)}
    assert open_after[-1] == 3  # m, n, z


def test_status_over_batches_equals_the_batch_form(spark, tmp_path):
    rng, t = random.Random(2), dt.datetime(2024, 1, 1)
    schema = "meeting_id string, event_id long, event_time timestamp, status string, progress double"
    rows = [(rng.choice("abcdef"), i, t + dt.timedelta(seconds=i // 3), rng.choice(J.STAGES), rng.choice([None, i / 100])) for i in range(120)]
    for part in (rows[:50], rows[50:80], rows[80:]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        J.start_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", f"{tmp_path}/out", once=True).awaitTermination()
    pick = lambda df: sorted((r.meeting_id, r.status, r.progress, r.finished) for r in df.collect())
    assert pick(J.newest_versions(spark.read.parquet(f"{tmp_path}/out"))) == pick(J.latest_status(spark.createDataFrame(rows, schema)))


def plain_quiet_chunks(values, below, window, least, most):
    out, s, n = [], 0, len(values)
    while s < n:
        fits = [w for w in range(s + least, min(s + most, n) - window + 1) if sum(v * v for v in values[w:w + window]) / window < below * below]
        stop, why = (fits[-1] + window // 2, "quiet") if fits else (s + most, "full") if s + most < n else (n, "end")
        out.append((s, stop - s, why))
        s = stop
    return out


def test_quiet_chunks_match_the_plain_loop(spark):
    rng, t, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    signals = {"a": [rng.choice([0.0, 0.1, 0.5]) for _ in range(400)], "b": [1.0] * 47, "c": [0.0] * 21, "d": [0.3], "e": [1.0] * 20}
    for k, values in signals.items():
        rows += [(k, i, t + dt.timedelta(hours=i // 2), v if v else None) for i, v in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, v double")
    got = E.quiet_chunks(df, "k", "ts", "i", "v", 0.2, 4, 6, 20).collect()
    for k, values in signals.items():
        want = plain_quiet_chunks(values, 0.2, 4, 6, 20)
        mine = sorted((r for r in got if r.k == k), key=lambda r: r["first"])
        assert [(r["first"], r["rows"], r["ended_by"]) for r in mine] == want
        assert [r.chunk_end for r in mine] == [t + dt.timedelta(hours=(a + n - 1) // 2) for a, n, _ in want]
    assert E.quiet_chunks(df.limit(0), "k", "ts", "i", "v").count() == 0
