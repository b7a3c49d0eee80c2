"""What wide steps send over the network, and how many tasks they are dealt over."""

from pyspark.sql import functions as F

from runqc.operators import align as A
from runqc.operators import distributions as D
from runqc.operators import ranking, timeline


def test_curves_are_not_shuffled(spark):
    """Occupied bins are shuffled, by bin and by group; what the kernel makes of them stays in its task."""
    reads = spark.range(2000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 5000).alias("length"))
    out = D.main_peak(D.smoothed_histogram(reads, ["g"]), ["g"])
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in above
    assert out.count() == 7


def test_ordered_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    """A task orders and sums a bounded number of rows; the result is that of few tasks."""
    reads = spark.range(3000).select(
        F.lit("a").alias("g"), (F.col("id") * 37 % 500).alias("start_time"), F.col("id").cast("string").alias("read_id"),
        (F.col("id") % 30).cast("double").alias("qscore"), (F.col("id") % 1000).alias("length"))
    few = sorted(map(tuple, timeline.rolling_quality_length(reads, ["g"]).collect()))
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 100)
    many = timeline.rolling_quality_length(reads, ["g"])
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert ", 90), REPARTITION_BY_NUM" in plan and ", 30), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, many.collect())) == few and len(few) == 2901


def test_reads_are_worked_out_once(spark):
    """What a read costs is paid once, however often the size join and the classification look at it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(i):
        made.add(1)
        return "ACGT" * (25 + i % 3)

    reads = spark.range(300).select(F.col("id").cast("string").alias("read_id"), F.lit("e").alias("experiment"), F.lit("b").alias("barcode"), costly("id").alias("seq"))
    targets = spark.createDataFrame([("T1", "ACGT" * 25, 100, 90, 102), ("T2", "ACGA" * 26, 104, 99, 110)], "target_id string, target_seq string, expected_length int, range_min int, range_max int")
    codes = spark.createDataFrame([("e", "b", "T1"), ("e", "c", "T2")], "experiment string, barcode string, target string")
    sized = reads.withColumn("length", F.length("seq")).select("read_id", "experiment", "length")
    assert A.size_candidates(sized, targets.withColumn("experiment", F.lit("e"))).count() == 400 and made.value <= 300
    made.value = 0
    assert {(r.length, r.method, r.target_id) for r in A.classify_reads(reads, codes, targets).collect()} == {(100, "edit_distance", "T1"), (104, "size", "T2"), (108, "size", "T2")}
    assert made.value <= 2 * 300  # length and text of one table: a plan may call it for each, but not for each look
