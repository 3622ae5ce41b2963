"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends at white space where the hash of the
bytes before it has two zero top bits (and at least MIN_BYTES have gone by, at most MAX_BYTES). Where the
last SOLID bytes have no white space (Chinese, Japanese, Thai, base64, minified code) it ends between
any two characters where the hash has five zero top bits. Cuts thus depend on nearby content only, so
an insertion shifts the chunks around it and no others. Chunks are deduplicated by a 128-bit digest of
their bytes without the white space at either end: of equal chunks the first by (doc_id, position)
stays. Chunks of white space alone are not counted. Neighbouring repeats in a document are joined into
spans, and spans of fewer than `min_words` words and of fewer than WORD_BYTES bytes other than white
space for each of these are left alone, as chance may repeat short phrases. Spans are whole chunks:
they are not extended into the partial chunk at either end.

The hash is computed for a whole text at once in numpy: a 32-byte window is the sum of two shifted
16-byte windows, and so on down. The chunks are written once. Digests are counted by a partially aggregated group-by, so a passage
in a third of all documents is one row a task; the join back broadcasts such hot digests, of which there
are few by definition; what is grouped per document is only that document's repeated chunks.

Defined results: null and empty texts have no chunks; rows with a null doc_id are left out; repeated
rows (same doc_id) are one document, whose own position counts once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize

MIN_BYTES, MAX_BYTES = 16, 1024
CUT_BITS = 2
SOLID, SOLID_BITS = 48, 5
#: Words that a joined span must have. A passage of 50 words loses a partial chunk at either end.
MIN_WORDS = 16
#: A span of fewer words also counts by its bytes, so many for a word.
WORD_BYTES = 12
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNKS = "doc_id long, at int, start int, length int, n_words int, n_solid int, d1 long, d2 long"


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the (up to) 32 bytes that end at each position."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        rolled = h.copy()
        rolled[width:] += h[:-width] << np.uint32(width)
        h, width = rolled, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks, after the white space at which they were cut or between characters of a solid text."""
    n = len(data)
    white, top = _WHITE[data], gear(data)
    cut = white & (top >> np.uint32(32 - CUT_BITS) == 0)
    gaps = np.flatnonzero(white)
    if np.diff(gaps, prepend=-1, append=n).max() > SOLID:
        here = np.arange(n)
        solid = here - np.maximum.accumulate(np.where(white, here, -1)) >= SOLID
        between = np.append(data[1:] & 0xC0 != 0x80, True)
        cut |= solid & between & (top >> np.uint32(32 - SOLID_BITS) == 0)
    places = np.flatnonzero(cut) + 1
    ends, last = [], 0
    for place in [*places.tolist(), n]:
        while place - last > MAX_BYTES:
            last += MAX_BYTES
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if place - last >= MIN_BYTES:
            ends.append(place)
            last = place
    if last < n:
        ends.append(n)
    return ends


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_128_digest
    names = ["doc_id", "at", "start", "length", "n_words", "n_solid", "d1", "d2"]
    for batch in batches:
        ids, parts, digests, held = [], [], [], 0
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            raw = text.as_py().encode() if text.is_valid else b""
            if raw and doc_id is not None:
                data = np.frombuffer(raw, np.uint8)
                ends, white = chunk_ends(data), _WHITE[data]
                starts, inside = [0, *ends[:-1]], np.add.accumulate(~white, dtype=np.int32)
                n_solid = np.diff(inside[np.subtract(ends, 1)], prepend=0)
                if not n_solid.all():  # the white-space chunks go, so that they don't break a run
                    starts, ends, n_solid = np.compress(n_solid, starts).tolist(), np.compress(n_solid, ends).tolist(), np.compress(n_solid, n_solid)
                digests += [digest(raw[a:b].strip(b" \t\n\x0b\x0c\r")) for a, b in zip(starts, ends, strict=True)]
                begun = np.flatnonzero(~white & np.append(True, white[:-1]))
                bounds = np.searchsorted(begun, ends)
                ids.append(np.full(len(ends), doc_id, np.int64))
                parts.append(np.array([np.arange(len(ends)), starts, np.subtract(ends, starts), np.diff(bounds, prepend=0), n_solid], np.int32))
                held += len(ends)
            if held and (held > 200_000 or k == batch.num_rows - 1):
                table, pair = np.concatenate(parts, axis=1), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), *[pa.array(c) for c in table], pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=names)
                ids, parts, digests, held = [], [], [], 0


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_id, at (its number), start and length in bytes, n_words, n_solid (bytes other than white space), digest (d1, d2)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunk, _CHUNKS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans that repeat an earlier document (or place): doc_id, start, length, n_words, n_chunks, first_doc_id, other_doc_ids."""
    held = materialize(chunks(docs), "chunks")
    key = ["d1", "d2"]
    common = held.groupBy(*key).agg(F.count("*").alias("times"), F.min("doc_id").alias("keeper")).filter("times > 1")
    common = materialize(common, "chunk-digests")
    again = join_counted(held, common, key, "times", held.count()).drop("times")
    # Within its keeper the first place of a chunk stays; repeated rows of a document are one.
    again = again.repartition("doc_id")
    place = F.row_number().over(W.partitionBy("doc_id", "at").orderBy("start", "d1"))
    own = F.row_number().over(W.partitionBy("doc_id", *key).orderBy("at"))
    again = again.withColumn("copy", place).filter("copy = 1").withColumn("own", own).filter("not (doc_id = keeper and own = 1)")
    run = F.col("at") - F.row_number().over(W.partitionBy("doc_id").orderBy("at"))
    spans = again.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("start").cast("long").alias("start"),
        (F.max(F.col("start") + F.col("length")) - F.min("start")).cast("long").alias("length"),
        F.sum("n_words").cast("long").alias("n_words"),
        F.count("*").alias("n_chunks"),
        F.min("keeper").alias("first_doc_id"),
        F.array_sort(F.collect_set("keeper")).alias("other_doc_ids"),
        F.sum("n_solid").alias("n_solid"),
    )
    return spans.filter((F.col("n_words") >= min_words) | (F.col("n_solid") >= WORD_BYTES * min_words)).drop("run", "n_solid")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and text without its repeated spans, for every document that has some."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, out, last = text.as_py().encode(), [], 0
                for span in gone:
                    out.append(raw[last : span["start"]])
                    last = span["start"] + span["length"]
                texts.append((b"".join(out) + raw[last:]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(spans, "doc_id")
    return held.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string")
