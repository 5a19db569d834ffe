import time

from pyspark.sql import functions as F

from eventloom.llm.common import DROP_SHUFFLES, cut


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {name for name in names if name.startswith("shuffle_")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(DROP_SHUFFLES, None)
    counts = spark.range(10_000).groupBy((F.col("id") % 7).alias("key")).count()
    kept = [cut(counts), cut(counts.join(spark.range(7), F.col("key") == F.col("id")).groupBy("id").agg(F.sum("count").alias("n")))]
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:  # Spark removes them beside the job
        time.sleep(0.2)
    assert not left
    assert kept[0].agg(F.sum("count")).first()[0] == kept[1].agg(F.sum("n")).first()[0] == 10_000
    assert counts.agg(F.sum("count")).first()[0] == 10_000  # the frame itself can be read again
    assert spark.conf.get(DROP_SHUFFLES, None) == setting
