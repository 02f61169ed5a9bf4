import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators.blocks import block_scan, index_block, row_index, with_halo


def _rows(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 9), rng.choice([None, i])) for k in "abc" for i in range(rng.randint(1, 40))]
    return spark.createDataFrame(rows, "k string, i int, v int, maybe int")


def test_block_scan_equals_plain_windows_in_both_directions(spark):
    df = _rows(spark)
    for down in (False, True):
        got = block_scan(df, ["k"], index_block("i", 4), ["i"], sums={"s": F.col("v")}, lasts={"l": F.col("maybe")},
                         lags={"g": F.col("v")}, descending=down)
        w = Window.partitionBy("k").orderBy(F.col("i").desc() if down else F.col("i"))
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.sum("v").over(run).alias("s"), F.last("maybe", True).over(run).alias("l"), F.lag("v").over(w).alias("g"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_row_index_is_dense(spark):
    got = row_index(_rows(spark), ["k"], index_block("i", 5), ["i"], "n").filter("n <> i").count()
    assert got == 0


def test_halo_gives_every_block_its_neighbours(spark):
    df = spark.range(20).select(F.col("id").cast("long").alias("i"))
    seen = with_halo(df, "i", before=3, after=1, size=5)
    w = Window.partitionBy("block").orderBy("i")
    got = (seen.withColumn("p", F.collect_list("i").over(w.rowsBetween(-3, -1))).withColumn("n", F.lead("i").over(w))
           .filter("not is_halo").orderBy("i").collect())
    assert [r.i for r in got] == list(range(20))
    for r in got:
        assert r.p == [x for x in range(r.i - 3, r.i) if x >= 0]
        assert r.n == (r.i + 1 if r.i < 19 else None)
