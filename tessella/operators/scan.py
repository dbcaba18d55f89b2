"""Running totals that no single key can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in one bucket.
BUCKET = 1 << 16


def running_total(rows: DataFrame, keys: list[str], order: str, value: str, out: str = "total", bucket: int = BUCKET) -> DataFrame:
    """The sum of `value` over the rows of a key before each row, in the order of a whole-number column that has no ties within a key.

    A key's rows are dealt out by buckets of the order column. Within a bucket a window gives the sum; the sums of the
    buckets, one row for each, are totalled by a second window and joined. So a task sorts at most a bucket's rows, however many a key has.
    """
    dealt = rows.withColumn("_bucket", F.floor(F.col(order) / bucket))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum")).select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return local.join(sums, [*keys, "_bucket"]).withColumn(out, F.col("_within") + F.col("_before")).drop("_bucket", "_within", "_before")
