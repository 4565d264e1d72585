"""Tables written once."""

from pyspark.sql import functions as F

from textlens.session import CLEANUP, materialize, materialize_bucketed


def test_written_tables_leave_no_shuffle_files(spark):
    driver = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    known = lambda: {b.toString() for b in _blocks(driver)}
    df = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = known()
    assert materialize(df).count() == 50
    first = known() - before
    assert materialize_bucketed(df, "t", 4, "k").agg(F.sum("n")).first()[0] == 1000
    second = known() - before - first
    # what is left is of the two reads, whose shuffles have one row a task
    assert len({x.split("_")[1] for x in first}) <= 1 and len({x.split("_")[1] for x in second}) <= 1
    assert spark.conf.get(CLEANUP, "false") == "false"


def _blocks(driver):
    found = driver.blockManager().diskBlockManager().getAllBlocks().iterator()
    while found.hasNext():
        b = found.next()
        if b.isShuffle():
            yield b
