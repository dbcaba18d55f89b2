import random

from pyspark.sql import functions as F

from tessella.operators import predictor, scan


def test_running_total(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7).alias("o"), (F.col("id") % 5).alias("v"))
    for bucket in (1, 50, 100_000):
        found = sorted(tuple(r) for r in scan.running_total(rows, ["k"], "o", "v", bucket=bucket).select("k", "o", "total").collect())
        want, totals = [], {}
        for r in sorted((r["k"], r["o"], r["v"]) for r in rows.collect()):
            want.append((r[0], r[1], totals.get(r[0], 0)))
            totals[r[0]] = totals.get(r[0], 0) + r[2]
        assert found == want


def test_running_sums_of_arrays(spark):
    rng = random.Random(1)
    for stride in (1, 3, 4):
        rows = [[rng.randrange(65536) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 191, 192, 193, 1000)]
        found = spark.createDataFrame(list(enumerate(rows)), "i int, v array<long>").select("i", predictor.running_sum_array(F.col("v"), 16, stride).alias("s")).collect()
        for r in found:
            want = []
            for k, x in enumerate(rows[r["i"]]):
                want.append((x + (want[k - stride] if k >= stride else 0)) % 65536)
            assert r["s"] == want
