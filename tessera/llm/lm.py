"""Language-model scores by stupid backoff, computed relationally.

Counts of word n-grams (1 to `order`) are taken over all documents; a document is scored with its own
occurrences taken out, so that backing off has a meaning on the corpus itself:

    S(w | context) = count(context w) / count(context)       if the n-gram occurs elsewhere
                   = ALPHA * S(w | shorter context)          else; at the end count(w) / words
    a word that occurs nowhere else counts as if it occurred once, after one more ALPHA.

The score is the mean natural logarithm of S over the words (A-Z lower-cased), perplexity its
exponential. Only n-grams inside one document count.

Plan: words are hashed in numpy from the UTF-8 bytes and documents cut into blocks of about BLOCK_WORDS words and written once as arrays (a block's
vocabulary of 64-bit word hashes, word numbers, document bounds). The blocks' n-grams, hashed to 64
bits, are exploded to rows (gram, block, times), one for each distinct n-gram of a block, and partitioned
by hash once; from that one exchange the count table is aggregated (gram, count in all, of n-grams that
more than one block has) and joined to the exploded rows. Their counts go back to the blocks, where the
documents' scores are summed up. N-grams are exploded by block and not by document because a row for
each document's n-gram would be several times the input; an n-gram in every document is one row a
block, so no key is hot. Rows grow in proportion to the corpus; nothing of it reaches the driver but the
word total.

Defined results: a text without words (null, empty) has n_words 0 and null scores; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

ALPHA, ORDER = 0.4, 2
BLOCK_WORDS = 600_000
#: Exploded n-grams of one partition of the count table, on average.
TABLE_GRAMS = 1_500_000
#: The count table is made in so many parts, one after the other, and the blocks are scored in as many:
#: the disk that shuffles need falls as this rises.
PASSES = 2
_BLOCKS = "block long, doc_ids binary, no_id binary, lengths binary, words binary, vocabulary binary, n_words long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pack(values: np.ndarray) -> bytes:
    """Low bytes first, then the next ones …: planes of sorted or small numbers compress well in a shuffle."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 bytes (A-Z lower-cased), and how many lie in each bounds[k] … bounds[k + 1].

    A word's hash is a polynomial in its bytes' random numbers, taken as a difference of running sums, so
    that all words of a piece of PIECE bytes (more only for a longer word) are hashed together.
    """
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        stop = min(at + PIECE, end)
        while stop < end:  # not inside a word
            gap = np.flatnonzero(_WHITE[data[max(at, stop - 4096) : stop]])
            if len(gap):
                stop = max(at, stop - 4096) + int(gap[-1]) + 1
                break
            stop = min(stop + 4096, end)
        part = data[at:stop]
        inside = ~_WHITE[part]
        edge = np.zeros(len(part) + 1, bool)  # a word begins here whatever comes before
        edge[bounds[(bounds >= at) & (bounds <= stop)] - at] = True
        edge[0] = True
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        first = np.flatnonzero(inside & (~before | edge[:-1]))
        last = np.flatnonzero(inside & (~after | edge[1:]))
        up, down = _powers(len(part))
        sums = np.append(np.uint64(0), np.cumsum(_RANDOM[part] * up[: len(part)], dtype=np.uint64))
        hashes.append(_mix((sums[last + 1] - sums[first]) * down[first] + (last + 1 - first).astype(np.uint64)))
        starts.append(first + at)
        at = stop
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


PIECE = 2_000_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANDOM[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]
_FACTOR = 0x9E3779B97F4A7C15 | 3  # fixed value: odd, its predecessor holds one factor of two


@lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        powers = np.full(size, np.uint64(base))
        powers[0] = 1
        tables.append(np.multiply.accumulate(powers))
    return tables[0], tables[1]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(max(PIECE + 4096, 1 << size.bit_length()))


def _block(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            # A word and the space after it take two bytes at least: more words than the block may have are cut off below.
            end = max(at + 1, int(np.searchsorted(places, places[at] + 12 * block_words, side="right")) - 1)
            end = min(end, batch.num_rows)
            values, lengths = word_hashes(raw, places[at : end + 1])
            held = np.cumsum(lengths)
            if held[-1] > block_words and end > at + 1:
                end = at + max(1, int(np.searchsorted(held, block_words, side="right")))
                values, lengths = values[: held[end - at - 1]], lengths[: end - at]
            vocabulary, numbers, counts = np.unique(values, return_inverse=True, return_counts=True)
            by = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by), dtype=np.uint32)
            own = ids.slice(at, end - at)
            arrays = [own.fill_null(0).to_numpy(), np.asarray(own.is_null()).astype(np.uint8), lengths, place[numbers], vocabulary[by]]
            row = [uuid.uuid4().int >> 65, *[_pack(a) for a in arrays], len(values)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)
            at = end


class Grams:
    """The n-grams of a block: for each order the distinct ones and where they occur."""

    def __init__(self, lengths: bytes, numbers: bytes, vocabulary: bytes, order: int):
        self.lengths = _unpack(lengths, np.int64)
        numbers, self.vocabulary = _unpack(numbers, np.uint32).astype(np.int64), _unpack(vocabulary, np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        start = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.place = np.arange(len(numbers)) - start  # in its document
        self.keys, self.inverse = [], []  # of each order; inverse[k] is by word, -1 where no such n-gram ends
        last, size, key = numbers, len(self.vocabulary), _mix(self.vocabulary ^ np.uint64(1))
        self.keys.append(key)
        self.inverse.append(last)
        for k in range(1, order):
            ok = np.flatnonzero(self.place >= k)
            pair = last[ok - 1] * np.int64(max(len(self.vocabulary), 1)) + numbers[ok]
            codes, inverse = np.unique(pair, return_inverse=True)
            left, right = codes // max(len(self.vocabulary), 1), codes % max(len(self.vocabulary), 1)
            key = _mix(key[left] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[right] + np.uint64(k + 1))
            last = np.full(len(numbers), -1, np.int64)
            last[ok] = inverse
            self.keys.append(key)
            self.inverse.append(last)

    def counts(self, k: int) -> np.ndarray:
        found = self.inverse[k]
        return np.bincount(found[found >= 0], minlength=len(self.keys[k]))

    def own(self, k: int) -> np.ndarray:
        """For each word, how often the n-gram that ends there occurs in its document (0 if none)."""
        found = self.inverse[k]
        ok = np.flatnonzero(found >= 0)
        _, inverse, counts = np.unique(self.doc[ok] * np.int64(max(len(self.keys[k]), 1)) + found[ok], return_inverse=True, return_counts=True)
        out = np.zeros(len(found), np.int64)
        out[ok] = counts[inverse]
        return out


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_words: int = BLOCK_WORDS, table_grams: int = TABLE_GRAMS, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, score, perplexity, n_backed_off of each whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = materialize(texts.mapInArrow(lambda batches: _block(batches, block_words), _BLOCKS), "lm-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-int(total) * order // table_grams))

    spans = blocks.select("block", "lengths", "words", "vocabulary")
    back = None  # of each block's n-grams that other blocks have too: how often these do
    for k in range(passes):
        own = spans.mapInArrow(partial(_explode, order=order, passes=passes, number=k), "gram long, block long, times long")
        exploded = own.repartition(max(1, parts // passes), "gram")
        # Both sides need the same three columns, so that Spark sends the exploded rows once.
        table = exploded.groupBy("gram").agg(F.sum("times").alias("total"), F.min("block").alias("first"), F.max("block").alias("last"))
        table = table.filter("first < last").select("gram", "total")
        found = exploded.join(table.hint("shuffle_hash"), "gram").select("block", "gram", (F.col("total") - F.col("times")).alias("elsewhere"))
        found = materialize(found, "lm-counts")
        back = found if back is None else back.unionByName(found)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        scored = [_scores(row, right, order, alpha, int(total)) for row in left.to_pylist()]
        return pa.concat_tables(scored) if scored else _SCORED.empty_table()

    scored = None
    for k in range(passes):
        mine = F.pmod(F.col("block"), F.lit(passes)) == k
        held = blocks.filter(mine).groupBy("block").cogroup(back.filter(mine).groupBy("block"))
        part = materialize(held.applyInArrow(finish, "doc_id long, n_words long, score double, n_backed_off long"), "lm-scores")
        scored = part if scored is None else scored.unionByName(part)
    release(blocks)
    return scored.select("doc_id", "n_words", "score", F.exp(-F.col("score")).alias("perplexity"), "n_backed_off")


def _explode(batches: Iterator[pa.RecordBatch], order: int, passes: int, number: int) -> Iterator[pa.RecordBatch]:
    """(gram, block, times) of the blocks' distinct n-grams whose hash falls to this pass."""
    for batch in batches:
        for block, lengths, numbers, vocabulary in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            grams = Grams(lengths, numbers, vocabulary, order)
            keys = np.concatenate(grams.keys)
            mine = np.flatnonzero((keys >> np.uint64(1)) % np.uint64(passes) == number)
            times = np.concatenate([grams.counts(k) for k in range(order)])
            by = mine[np.argsort(keys[mine])]  # neighbours share their first bytes, which compresses
            for at in range(0, len(by), 200_000):
                part = by[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(np.full(len(part), block)), pa.array(times[part])], names=["gram", "block", "times"])


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("n_backed_off", pa.int64())])


def _scores(row: dict, back: pa.Table, order: int, alpha: float, words_in_all: int) -> pa.Table:
    """The documents of one block; `back` has, for its n-grams that other blocks have too, how often these do."""
    grams = Grams(row["lengths"], row["words"], row["vocabulary"], order)
    keys = np.concatenate(grams.keys).view(np.int64)
    totals = np.concatenate([grams.counts(k) for k in range(order)])
    by = np.argsort(keys, kind="stable")
    if back.num_rows:
        totals[by[np.searchsorted(keys[by], back.column("gram").to_numpy())]] += back.column("elsewhere").to_numpy()
    found = []  # by order: occurrences in other documents of the n-gram that ends at each word
    for k, held in enumerate(np.split(totals, np.cumsum([len(k) for k in grams.keys])[:-1])):
        ends = grams.inverse[k]
        found.append(np.where(ends >= 0, held[ends] if len(held) else 0, 0) - grams.own(k))
    rest = np.maximum(words_in_all - np.repeat(grams.lengths, grams.lengths), 1)
    value = np.where(found[0] > 0, found[0] / rest, alpha / rest)
    backed = found[0] <= 0
    for k in range(1, order):
        context = np.concatenate([[0], found[k - 1][:-1]])
        has = grams.place >= k
        seen = has & (found[k] > 0)
        value = np.where(seen, found[k] / np.maximum(context, 1), np.where(has, alpha * value, value))
        backed = np.where(has, ~seen, backed)
    n = grams.lengths
    sums = np.bincount(grams.doc, weights=np.log(value), minlength=len(n))
    off = np.bincount(grams.doc, weights=backed, minlength=len(n)).astype(np.int64)
    mean = [s / c if c else None for s, c in zip(sums.tolist(), n.tolist(), strict=True)]
    ids = pa.array(_unpack(row["doc_ids"], np.int64), mask=_unpack(row["no_id"], np.uint8).astype(bool))
    return pa.Table.from_arrays([ids, pa.array(n), pa.array(mean, pa.float64()), pa.array(off)], schema=_SCORED)
