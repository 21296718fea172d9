from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.plans.scan import running_totals


def test_running_totals_equals_window_with_hot_key(spark):
    n = 3000
    df = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 17).alias("user"),  # user 1 is hot
        F.timestamp_seconds((F.col("id") * 7919 % 100000).cast("long")).alias("ts"),
        F.col("id").alias("eid"),
        (F.col("id") % 5 == 0).cast("int").alias("flag"),
        (F.col("id") % 97 == 0).cast("int").alias("stop"))
    w = Window.partitionBy("user").orderBy("ts", "eid").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(df.select("eid", F.sum("flag").over(w).alias("s"), F.max("stop").over(w).alias("m")).collect())
    for unit in ("minute", "hour", "year"):
        got = running_totals(df, "user", "ts", "eid", sums={"s": F.col("flag")}, maxes={"m": F.col("stop")},
                             unit=unit).select("eid", "s", "m")
        assert sorted(got.collect()) == want
    ntz = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = running_totals(ntz, "user", "ts", "eid", sums={"s": F.col("flag")}, maxes={"m": F.col("stop")})
    assert sorted(got.select("eid", "s", "m").collect()) == want
    num = df.withColumn("ts", F.col("eid") * 7919 % 100000)
    wn = Window.partitionBy("user").orderBy("ts", "eid").rowsBetween(Window.unboundedPreceding, 0)
    want_n = sorted(num.select("eid", F.sum("flag").over(wn).alias("s")).collect())
    got = running_totals(num, "user", "ts", "eid", sums={"s": F.col("flag")}, size=500).select("eid", "s")
    assert sorted(got.collect()) == want_n
