"""What a step leaves on disk."""

import time

from pyspark.sql import functions as F

from skybias.session import measured


def test_a_stored_step_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(20_000).groupBy(F.pmod("id", F.lit(5_000)).alias("k")).agg(F.sum("id").alias("total"))
    assert measured(rows, "sums").count() == 5_000
    until = time.time() + 10  # executors delete them in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
