"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if it holds more than one in HOT_SHARE of all rows, so there are fewer hot keys than that at any size.
HOT_SHARE = 10_000
#: A bitmap of keys has at most so many bits (128 MiB): beyond some 60 million keys it lets more rows through, never fewer.
MAX_BITS = 1 << 30
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable.

    A column that is referred to inside a higher-order function would otherwise be
    evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A folder of our own is made only where none is set, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts lineage, survives lost executors.

    Shuffle files of the write are removed when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined by the columns `on` (nulls match) to `table`, which has one row a key, hot keys apart.

    `count` is a column of the table: how many of the `total` rows have the key. Keys above one in
    HOT_SHARE of them are fewer than HOT_SHARE, so these are broadcast; the others, of which none can
    fill a task, are shuffled. `how` is inner or left; the same plan holds at every size.
    """
    other = [c for c in table.columns if c not in on]
    named = table.select(*[F.col(c).alias(f"_{c}_") for c in on], *other)
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    hot = F.broadcast(named.filter(F.col(count) > total // HOT_SHARE))
    cold = named.filter(F.col(count) <= total // HOT_SHARE)
    keys = [f"_{c}_" for c in on]
    rest = rows.join(hot.select(keys), same, "left_anti")
    return rows.join(hot, same).drop(*keys).unionByName(rest.join(cold, same, how).drop(*keys))


class KeyBits:
    """A bitmap of the hashes of a table's keys, to sort out rows that are surely not among them.

    It is built in Spark and broadcast in blocks of 4,096 bits, 16 bits a key (counted), MAX_BITS at most.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        self.bits = 1 << max(12, min(MAX_BITS.bit_length() - 1, (16 * keys.count()).bit_length()))
        place = keys.select(self._place([F.col(c) for c in columns]).alias("_x"))
        held = place.groupBy(F.shiftright("_x", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_x & 63 as int)))").alias("_v"))
        pairs = F.map_from_entries(F.collect_list(F.struct((F.col("_w") % 64).alias("k"), "_v")))
        full = held.groupBy(F.shiftright("_w", 6).alias("_block")).agg(pairs.alias("_m"))
        words = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda k: F.coalesce(F.col("_m")[k], F.lit(0).cast("long")))
        self.blocks = F.broadcast(full.select("_block", words.alias("_words")))

    def _place(self, key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits).cast("long"))

    def mark(self, rows: DataFrame, *key: Column) -> DataFrame:
        """The rows with a column _may: false if the key is surely not in the table."""
        held = rows.withColumn("_x", self._place(list(key))).join(self.blocks, F.shiftright("_x", 12) == F.col("_block"), "left")
        bit = F.expr("(shiftright(_words[cast((_x >> 6) & 63 as int)], cast(_x & 63 as int)) & 1) = 1")
        return held.withColumn("_may", F.coalesce(bit, F.lit(False))).drop("_x", "_block", "_words")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """`df`, range-sorted by `order`, with running sums (new column: summed column) and the row number _at.

    Rows are dealt to ranges of the order and written once; each range is summed by itself and gets the
    sums of the ranges before it from a table that has one row a range, so no task sees more than a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    zero = F.lit(0).cast("long")
    ranges = ranges.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(before), zero).alias(c) for c in ("_n", *[f"_{k}" for k in sums])])
    # One row a range, of which there are as many as shuffle partitions.
    held = dealt.join(F.broadcast(ranges), F.col("_range") == F.col("_r"))
    held = held.withColumns({"_at": F.col("_n") + F.count("*").over(inside), **{k: F.col(f"_{k}") + F.sum(c).over(inside) for k, c in sums.items()}})
    return held.drop("_range", "_r", "_n", *[f"_{k}" for k in sums])


def packed(docs: DataFrame, name: str = "d") -> DataFrame:
    """All columns as one struct, so that names of our own can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def without(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is not in the (distinct) one-column table `gone`.

    Only rows that a bitmap of `gone` can't exclude are shuffled; all others pass in the scan.
    """
    key = gone.columns[0]
    own = F.col(f"d.`{column}`").cast(gone.schema[key].dataType)
    marked = KeyBits(gone, key).mark(packed(docs), own)
    may = marked.filter("_may").join(gone.withColumnRenamed(key, "_gone"), own == F.col("_gone"), "left_anti")
    return marked.filter("not _may").select("d.*").unionByName(may.select("d.*"))
