"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a random but fixed order (by MD5 of seed and id). A copy of a
document finishes at the virtual time (tokens of its source up to and including it) / (target of
the source); second and third copies follow after the whole source. Copies of all sources are
then range-sorted by finish time and taken until the budget, the sum of the targets, is reached.

Targets: weight share of all tokens, at most `max_copies` times the source's own tokens; what
exceeds that goes to the other sources by weight until none is above (water filling in closed
form over the table of sources).

All running totals (over sources in name order, over sources by the level at which they are full, over
documents in their sources' orders, over copies by finish time) are taken by `running`: a global range
sort, sums inside each range, and sums of the ranges before. So neither the largest source nor the
table of sources, which may have millions, meets in one task; a source that holds a third of all
documents gets its target in a broadcast join. The cut, one place in the global order, is compared with
each copy's own place, and nothing needs to be joined back.

Defined results: rows repeated with the same doc_id, source and size are one unit and share their
fate; null text has size 0; a null source is a source, last in order; a source without tokens has
target 0 and nothing taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize, packed, running, word_count

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"


def targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, ahead (tokens of the sources before it), target; weights repeat over
    sources in code point order, null last."""
    by_name = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = running(sums, [by_name], {"upto": "source_size"}, "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    ranked = named.select("source", "source_size", "n_docs", (F.col("upto") - F.col("source_size")).alias("ahead"), weight.alias("weight"))
    ranked = ranked.withColumn("cap", max_copies * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    steps = materialize(running(ranked, [F.col("level").asc(), by_name], {"capped": "cap", "weighed": "weight"}, "mix-levels"), "mix-steps")
    total, weighs = steps.agg(F.sum("source_size"), F.sum("weight")).first()
    # A source's share if it and all that are full later share what the ones before leave.
    left = F.lit(total) - (F.col("capped") - F.col("cap"))
    share = left.cast("double") / (F.lit(weighs) - (F.col("weighed") - F.col("weight")))
    cut = steps.withColumn("share", share).filter("share <= level").agg(F.min(F.struct("_at", "share")).alias("cut")).first()["cut"]
    at, share = (cut["_at"], cut["share"]) if cut else (None, None)
    target = F.when(F.lit(at).isNotNull() & (F.col("_at") >= F.lit(at)), F.col("weight") * F.lit(share).cast("double")).otherwise(F.col("cap").cast("double"))
    return steps.select("source", "source_size", "n_docs", "ahead", target.alias("target"))


def _finish(copy):
    return F.try_divide((copy * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def _place(finish, copy):
    return F.struct(finish.alias("finish"), F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("size").alias("size"), copy.cast("int").alias("copy"))


def mix_units(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Per unit (doc_id, source, size): times (rows), source_size, target, copies taken of each row."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    total = sized.count()
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    units = units.withColumn("tokens", F.col("size") * F.col("times")).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    if not total:
        empty = units.select("doc_id", "source", "size", "times", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"))
        return empty
    aims = materialize(targets(sized, weights, max_copies), "mix-targets")
    queued = running(units, [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc(), F.col("size").asc()], {"run": "tokens"}, "mix-queues")
    placed = join_counted(queued, aims, ["source"], "n_docs", total)
    placed = placed.select("doc_id", "source", "size", "times", "tokens", "key", (F.col("run") - F.col("ahead")).alias("upto"), "source_size", "target")
    placed = materialize(placed, "mix-placed")
    cut = _cut(placed, aims, max_copies)
    taken = F.lit(0)
    if cut is not None:
        for copy in range(max_copies):
            finish = _finish(F.lit(copy))
            taken = taken + F.when(finish.isNotNull() & (_place(finish, F.lit(copy)) <= _literal(cut, placed)), 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "times", "source_size", "target", taken.cast("int").alias("copies"))


def _cut(placed: DataFrame, aims: DataFrame, copies: int):
    """The last place in the global order that the budget reaches, as one row; None if nothing fits."""
    budget = aims.agg(F.sum("target")).first()[0]
    if not budget:
        return None
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("finish", _finish(F.col("copy"))).filter("finish is not null")
    place = ["finish", "key", "doc_id", "source", "size", "copy"]
    in_order = running(each.select(*place, "tokens"), [F.col(c).asc() for c in place], {"run": "tokens"}, "mix-copies")
    return in_order.filter(F.col("run") <= float(round(budget))).agg(F.max(F.struct(*place)).alias("p")).first()["p"]


def _literal(cut, placed: DataFrame):
    kinds = dict(placed.dtypes) | {"finish": "double", "copy": "int"}
    return F.struct(*[F.lit(cut[c]).cast(kinds[c]).alias(c) for c in ("finish", "key", "doc_id", "source", "size", "copy")])


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (tokens, copies counted), copies."""
    units = mix_units(docs, **how)
    return units.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_")).drop("_")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as it is taken."""
    units = mix_units(docs, **how).filter("copies > 0").select("doc_id", "source", "size", "copies")
    each = packed(docs).withColumn("n", word_count(F.col("d.text")))
    same = F.col("d.doc_id").eqNullSafe(F.col("doc_id")) & F.col("d.source").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    return each.join(units, same).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")
