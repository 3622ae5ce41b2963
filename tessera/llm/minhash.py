"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

A document is the set of its distinct word shingles; two are linked if their Jaccard similarity is
at least `similarity`; connected documents form a group of which the smallest doc_id stays.

1. One pass makes the sets (64-bit shingle hashes, in the JVM) and, in Arrow batches, minima under
   HASHES permutations: band keys of ROWS minima each, and the low BITS bits of all minima, packed.
2. Rows with the same number of shingles and the same digest of them (a 64-bit sum and a 64-bit xor of
   two mixes of each shingle's hash) are one class, represented by its smallest doc_id. Sets of one class
   are taken to be equal without being compared again; of n different ones a wrong pair is expected in
   n**2 / 2**129 cases.
3. Classes that share a band key are candidates. In each band bucket every class first meets the
   bucket's smallest (a star, not all pairs). Candidates whose similarity, estimated from the packed
   bits with random collisions corrected for, is far below the threshold are dropped; the rest are
   confirmed on their full sets, and components are formed.
4. In buckets that still hold several components, all pairs across components are tested in the
   join itself, by the packed bits and then on their full sets; pairs that fail are never emitted.
   A bucket of near copies is one component by then, so no group is expanded into all its pairs,
   and no pair that shares a band and passes the estimate is left out.

A pair at the threshold shares no band with probability (1 - similarity**ROWS)**BANDS (1.2e-7 at
0.8); the estimate's margin lies more than six standard deviations off. Nothing is capped.

Defined results: null or empty text has an empty set and is linked with nothing; a null doc_id is
linked with nothing and is kept with a null component; repeated rows share a class, rows that share
a doc_id are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KeyBits, ascii_lower, join_counted, let, materialize, release, without, words
from tessera.llm.graph import connected_components

SIMILARITY_PERCENT = 80
WIDTH = 5
ROWS, BANDS, BITS = 5, 40, 2
HASHES = ROWS * BANDS
_LONGS = -(-HASHES // 64)
#: Standard deviations that an estimate may lie below the threshold before a candidate is dropped.
MARGIN = 6.5
_SIGNED = "doc_id long, n long, d1 long, d2 long, bands array<long>, bits array<long>"


def shingles(text: Column, width: int) -> Column:
    """Hashes of the distinct shingles; a text with fewer words is one shingle, one without is none."""

    def sets(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
        return F.when(F.size(ws) >= width, F.array_distinct(many)).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), sets)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ragged sets (none empty): two digests, BANDS band keys and the packed low bits of the minima."""
    full = values.view(np.uint64)
    d1 = np.add.reduceat(_mix(full, 0x1234567), starts)
    d2 = np.bitwise_xor.reduceat(_mix(full, 0x89ABCDEF), starts)
    short = (full ^ (full >> np.uint64(32))).astype(np.uint32)
    random = np.random.default_rng(20240601)
    factors = random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    bands = np.empty((len(starts), BANDS), np.uint64)
    bits = np.zeros((len(starts), BITS * _LONGS), np.uint64)
    for j in range(HASHES):
        low = np.minimum.reduceat(short * factors[j] + shifts[j], starts).astype(np.uint64)
        band = j // ROWS
        bands[:, band] = _mix(low if j % ROWS == 0 else low ^ (bands[:, band] << np.uint64(1)), 0x5151 + j)
        for bit in range(BITS):
            bits[:, bit * _LONGS + j // 64] |= ((low >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j % 64)
    return d1, d2, bands, bits


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "d1", "d2", "bands", "bits"]
    for batch in batches:
        lists = batch.column(1)
        ends = np.asarray(lists.offsets, np.int64)
        at = 0
        while at < batch.num_rows:  # bounded numbers of shingles at a time
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + 1_500_000, side="right")) - 1)
            end = min(end, batch.num_rows)
            offsets = ends[at : end + 1]
            n = np.diff(offsets)
            values = np.asarray(lists.values)[offsets[0] : offsets[-1]]
            some = n > 0
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands, bits = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), BITS * _LONGS), np.uint64)
            if some.any():
                d1[some], d2[some], bands[some], bits[some] = signatures(values, (offsets[:-1] - offsets[0])[some])

            def rows(x: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), rows(bands), rows(bits)], names=names)
            at = end


def _estimate(a: str, b: str) -> Column:
    """Similarity by equal low bits of minima, corrected for chance collisions."""
    differ = F.lit(0)
    for k in range(_LONGS):
        planes = F.lit(0).cast("long")
        for bit in range(BITS):
            at = bit * _LONGS + k
            planes = planes.bitwiseOR(F.col(f"{a}.s{at}").bitwiseXOR(F.col(f"{b}.s{at}")))
        differ = differ + F.bit_count(planes)
    return 1 - differ / F.lit(HASHES * (1 - 2.0**-BITS))


def _close(a: str, b: str, percent: int) -> Column:
    """Neither sizes nor packed bits exclude that the pair is linked."""
    p = (1 - percent / 100) * (1 - 2.0**-BITS)
    least = 1 - (p + MARGIN * (p * (1 - p) / HASHES) ** 0.5) / (1 - 2.0**-BITS)
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (_estimate(a, b) >= least)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, set of the documents whose id is among `ids` (id), and of a few more by the bitmap's errors."""
    ids = materialize(ids, "near-ids")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = KeyBits(ids, "id").mark(held, F.col("doc_id")).filter("_may and doc_id is not null")
    return materialize(held.select("doc_id", shingles(F.col("text"), width).alias("set")).filter(F.size("set") > 0).dropDuplicates(), "near-sets")


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _sets(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), width)
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("either"))
    links = materialize(held.filter(100 * F.col("both") >= percent * F.col("either")).select("a", "b").distinct(), "near-links")
    release(sets)
    return links


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text"), width).alias("set"))
    signed = materialize(sets.mapInArrow(_sign, _SIGNED), "near-signed")
    digest = ["n", "d1", "d2"]
    first = F.min(F.struct("doc_id", "bands", "bits")).alias("m")
    classes = materialize(signed.filter("n > 0 and doc_id is not null").groupBy(*digest).agg(first).select(*digest, F.col("m.doc_id").alias("rep"), "m.bands", "m.bits"), "near-classes")
    packed = classes.select("rep", "n", *[F.col("bits")[k].alias(f"s{k}") for k in range(BITS * _LONGS)])
    banded = classes.select("rep", F.explode("bands").alias("key"))

    centres = banded.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("top"), F.count("*").alias("held")).filter("a < top").select("key", "a", "held")
    stars = join_counted(banded, centres, ["key"], "held", BANDS * classes.count()).filter("rep != a").select("a", F.col("rep").alias("b")).distinct()
    near = stars.join(packed.alias("x"), F.col("a") == F.col("x.rep")).join(packed.alias("y"), F.col("b") == F.col("y.rep"))
    near = materialize(near.filter(_close("x", "y", percent)).select("a", "b").distinct(), "near-pairs")
    links = _confirm(docs, near, width, percent)
    groups = materialize(connected_components(links), "near-groups")

    # Buckets that hold several components: every pair across them, unless tested before.
    placed = banded.join(groups, F.col("rep") == F.col("node"), "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = materialize(placed.join(mixed, "key").join(packed, "rep"), "near-open")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _close("x", "y", percent)
    # Only rows that have such a partner are joined to their full sets; pairs are confirmed in the join.
    busy = materialize(open_.alias("x").join(open_.alias("y"), apart, "left_semi"), "near-busy")
    full = busy.join(_sets(docs, busy.select(F.col("rep").alias("id")).distinct(), width), F.col("rep") == F.col("doc_id"))
    linked = (100 + percent) * F.size(F.array_intersect("x.set", "y.set")) >= percent * (F.size("x.set") + F.size("y.set"))
    more = full.alias("x").join(full.alias("y"), (F.col("x.rep") < F.col("y.rep")) & apart & linked).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = materialize(more, "near-more")
    release(open_)
    release(busy)
    if not more.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = materialize(connected_components(stars.unionByName(more)), "near-groups")

    labelled = classes.select(*digest, "rep").join(groups, F.col("rep") == F.col("node"), "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    linked = signed.filter("n > 0 and doc_id is not null").select("doc_id", *digest).join(labelled, digest).select("doc_id", "n", "component_id")
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The documents of which one stays for each group, with all their columns."""
    gone = materialize(near_groups(docs, width, percent).filter(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return without(docs, gone, "doc_id")
