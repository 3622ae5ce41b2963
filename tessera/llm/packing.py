"""Packing token sequences by best-fit decreasing.

Documents are tokenised in Python workers (Arrow in, Arrow out) and cut: full windows first, then
one remainder. Pieces are dealt evenly into shards of bounded size and each shard is packed on its
own: pieces in decreasing length, each into the open window with the least room that still holds
it, found by a segment tree over remaining capacity. No task sees more than one shard.

Whole texts are encoded by the ranks of the vocabulary, which gives the library's ids for byte-level
BPE; a worker holds the vocabulary and some MB of text, and remembers nothing from text to text.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null
id is carried along; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WINDOW = 1024
#: Pieces in a shard, on average; more only save a little padding.
SHARD_PIECES = 4_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _rank_encoder(path: str):
    """The same byte-level BPE for tiktoken, which merges words several times faster; None if the file is of another kind.

    Its ranks are the ids, which is right if merges made the ids in their order.
    """
    import tiktoken

    raw = json.loads(Path(path).read_text())
    model, before = raw["model"], raw.get("pre_tokenizer") or {}
    plain = not raw.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others follow from 0x100 on
    hidden = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(hidden)}
    vocabulary, special = model["vocab"], {t["content"] for t in raw.get("added_tokens", [])}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary[x + y] for x, y in pairs]
    if made != sorted(set(made)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    # No special token is ever allowed in a text, but with none known an empty pattern would be looked for at every character.
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"\0\0": len(vocabulary)})


#: Fixed value: the pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, by a `tokenizers` file.

    Byte-level BPE goes through its ranks. What that can't take is left to the library itself: texts that hold
    an added token, runs of white space for which the pattern would need a deep stack, and files of another kind.
    """

    _RUN = re.compile(r"\s{10000}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._ranked = Tokenizer.from_file(path), _rank_encoder(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if self._ranked and not any(t in text for t in self._added) and not self._RUN.search(text):
            return self._ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per worker process, which reads the vocabulary once."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian uint32) of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = _encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            ids, texts, sizes = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            at = 0
            while at < len(ids):  # some MB of text at a time
                end, held = at, 0
                while end < len(ids) and held < 1_000_000:
                    held += sizes[end]
                    end += 1
                yield from _cut(ids.slice(at, end - at), [encoder.encode(t) + stop for t in texts.slice(at, end - at).to_pylist()], window)
                at = end

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text, F.octet_length(text)).mapInArrow(cut, PIECES)


def _cut(doc_ids: pa.Array, found: list[bytes], window: int, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The windows of the documents' ids, `most` to a batch; they lie end to end, so their bytes are taken as they are."""
    tokens = np.array([len(x) // 4 for x in found], np.int64)
    pieces = -(-tokens // window)
    of = np.repeat(np.arange(len(found)), pieces)
    start = window * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(window, tokens[of] - start)
    ends, raw = 4 * np.cumsum(length), memoryview(b"".join(found))
    for at in range(0, len(of), most):
        part = slice(at, at + most)
        first = int(ends[at] - 4 * length[at])
        offsets = np.concatenate([[0], ends[part] - first]).astype(np.int32)
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[first : first + int(offsets[-1])])])
        columns = [doc_ids.take(pa.array(of[part])), pa.array(start[part]), pa.array(length[part]), pa.array(tokens[of[part]]), ids]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are at most `window` and come in decreasing order."""
    size = 1 << window.bit_length()
    tree = bytearray(2 * size)  # a node is 1 if an open window has room in its range
    room: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, need in enumerate(lengths.tolist()):
        at = need + size
        if not tree[at]:
            while at > 1 and not (not at & 1 and tree[at + 1]):
                at >>= 1
            at = at + 1 if at > 1 else 0
            while 0 < at < size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        if at:
            left = at - size
            own = room[left].pop()
            if not room[left]:
                at_ = at
                tree[at_] = 0
                while at_ > 1 and not (tree[at_] or tree[at_ ^ 1]):
                    at_ >>= 1
                    tree[at_] = 0
        else:
            left, own, n = window, n, n + 1
        bins[k], offsets[k] = own, window - left
        left -= need
        if left:
            if not room[left]:
                at = left + size
                while at and not tree[at]:
                    tree[at] = 1
                    at >>= 1
            room[left].append(own)
    return bins, offsets


def pack_pieces(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset, which replace columns of these names; all others are carried along."""
    held = materialize(pieces, "pack-pieces")
    shards = max(1, -(-held.count() // shard_pieces))
    shard = "_shard"
    while shard in held.columns:
        shard += "_"
    dealt = held.withColumn(shard, F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))
    carried = [c for c in held.columns if c not in ("sequence_id", "offset")]

    def pack(frame):
        frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(frame["length"].to_numpy(), window)
        return frame[carried].assign(sequence_id=frame[shard].astype("int64") * (1 << 32) + bins, offset=offsets)

    kinds = ", ".join(f"`{c}` {t}" for c, t in held.dtypes if c in carried)
    return dealt.groupBy(shard).applyInPandas(pack, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pieces with their ids and their place in the packed sequences."""
    return pack_pieces(token_pieces(docs, tokenizer, window, end_id), window)


def pack_digests(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """The output of pack_documents with a CRC-32 taken of the packed ids in their place."""
    packed = pack_documents(docs, tokenizer, window, end_id)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
