"""Exact deduplication: group by a 128-bit content hash, confirm by comparing bytes.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text.
Of equal texts the row with the largest doc_id stays (a null doc_id is smaller than any other).

Plan, the same at every size: one narrow pass writes (doc_id, hash, sha256); a partially aggregated
group-by finds the groups of two or more. Bytes are compared by a partial min/max of the text per hash
over the rows whose hash a bitmap of the groups' hashes can't exclude, so texts that occur once are not
shuffled (but for the bitmap's errors, which compare equal to themselves), and a task passes on two
texts per hash at most, however large the group is. Groups that turn out to mix texts (hash collisions)
are grouped again by the text itself. Narrow rows then meet their group in a join that keeps hot groups
apart. To drop copies, only rows whose doc_id may be among the dropped ones are shuffled.

Defined results: an empty table gives an empty result; repeated rows with the same doc_id and text form
a group of which one row is kept; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KeyBits, ascii_lower, join_counted, materialize, packed


def content_hash(text: Column) -> Column:
    """128-bit hash of the normalised text, as 16 bytes."""
    return F.unhex(F.md5(text))


def _norm(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _sizes(rows: DataFrame, *key: str) -> DataFrame:
    """Groups of two or more: their size, largest doc_id and the row that stays."""
    stays = F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row")
    return rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), stays, F.count("*").alias("group_size")).filter("group_size > 1")


def _judged(docs: DataFrame, hash_of) -> DataFrame:
    """Narrow rows (doc_id, row, h, sha, part) with their group (keep_id, keep_row, group_size; null if alone)."""
    norm = docs.select("doc_id", _norm(F.col("text")).alias("norm"))
    rows = materialize(norm.select("doc_id", F.monotonically_increasing_id().alias("row"), hash_of(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha")), "exact-rows")
    groups = materialize(_sizes(rows, "h"), "exact-groups")
    texts = norm.select("norm", hash_of(F.col("norm")).alias("h"))
    texts = KeyBits(groups, "h").mark(texts, F.col("h")).filter("_may")
    mixed = materialize(texts.groupBy("h").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a != b").select("h"), "exact-mixed")
    if mixed.isEmpty():
        rows, groups = rows.withColumn("part", F.lit("")), groups.withColumn("part", F.lit(""))
    else:  # collisions: within these hashes the SHA-256 tells texts apart, after bytes showed that they differ
        flagged = rows.join(mixed.withColumn("hit", F.lit(True)), "h", "left")
        rows = materialize(flagged.select("doc_id", "row", "h", "sha", F.when(F.col("hit"), F.col("sha")).otherwise("").alias("part")), "exact-split")
        groups = materialize(_sizes(rows, "h", "part"), "exact-regrouped")
    return join_counted(rows, groups, ["h", "part"], "group_size", rows.count(), "left")


def exact_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    alone = F.col("group_size").isNull()
    return _judged(docs, hash_of).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """The documents that stay, with all their columns."""
    judged = _judged(docs, hash_of).filter("group_size is not null")
    marks = judged.groupBy("doc_id", "h", "part").agg(F.max(F.col("row") == F.col("keep_row")).alias("stays"), F.count("*").alias("times"))
    marks = materialize(marks.filter("not stays or times > 1").withColumnRenamed("doc_id", "id"), "exact-marks")
    marked = KeyBits(marks, "id").mark(packed(docs), F.col("d.doc_id"))
    text = _norm(F.col("d.text"))
    keyed = marked.filter("_may").select("d", hash_of(text).alias("hash"), F.sha2(text, 256).alias("sha"))
    same = F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")) & ((F.col("part") == "") | (F.col("part") == F.col("sha")))
    out = marked.filter("not _may").select("d.*").unionByName(keyed.join(marks, same, "left_anti").select("d.*"))
    repeated = marks.filter("stays")
    if repeated.isEmpty():
        return out
    once = keyed.join(repeated, same).dropDuplicates(["id", "hash", "part"])  # rows repeated with their doc_id
    return out.unionByName(once.select("d.*"))
