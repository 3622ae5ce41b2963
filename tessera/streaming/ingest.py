"""Incremental ingest: new bar files merged into the lake, late corrections winning, once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.cleaning import clean_bars, merge_bars
from tessera.schemas import BAR, Partition
from tessera.session import scratch
from tessera.sources.bars import read_bars, write_bars


def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(BAR).parquet(folder)


def merge_stream(incoming: DataFrame, root: str, partition: Partition, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, then stop. A batch that is run again merges to the same lake.

    A batch rewrites the partition that it falls in: bars that come often should go to small partitions.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        merged = merge_bars(read_bars(spark, root, partition), clean_bars(batch))
        # Written beside the lake first, as the merge reads what it is to replace.
        staged = scratch(spark, "stream-batch")
        merged.write.parquet(staged)
        write_bars(spark.read.schema(merged.schema).parquet(staged), root, partition)
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
