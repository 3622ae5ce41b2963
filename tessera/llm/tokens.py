"""Token counts by rank-synchronous array merging.

A sentencepiece BPE model is read once per worker as a table of symbol pairs: which two adjacent
symbols join into which piece, at which rank (by score). Texts are cut into pre-tokens that no
piece can span (a piece holds spaces only at its front, and a character that is in no piece stands
alone); pre-tokens seen before are looked up, new ones are counted together: all of them lie as
ragged sequences in one flat numpy array, and in each round every sequence applies its lowest-rank
pair, all its occurrences at once. Where that could differ from one merge at a time (a new pair
would rank lower, or different pairs tie on score) the sequence only applies its leftmost. What
survives is counted; a character that the model doesn't know counts its UTF-8 bytes.

Defined results: null and empty text have 0 tokens; every row gives a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
SPACE = "▁"
_NONE = np.int64(1 << 40)
_SLOT_BITS = 21


class PieceCounter:
    """Counts of tokens by the pair table of a sentencepiece BPE model."""

    def __init__(self, path: str, remember: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        spanning = next((p for p in pieces if SPACE in p.lstrip(SPACE)), None)
        if spanning:
            raise ValueError(f"piece {spanning!r} spans words; this model needs whole-text merging")
        scores = {i: model.get_score(i) for i in plain}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, len(symbols) + n)
        self._base = 1 + max(symbols.values())  # unknown characters: base + bytes
        self._width = np.int64(self._base + 8)
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * int(self._width) + b] = (rank_of[scores[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        self._keys = np.append(keys, np.int64(1 << 62))
        self._ranks = np.array([pairs[int(k)][0] for k in keys] + [int(_NONE)], np.int64)
        self._made = np.array([pairs[int(k)][1] for k in keys] + [-1], np.int64)
        # Hash slots: the one pair that falls there, or -1 for none, or -2 for several (then a binary search).
        slots = self._slot(keys)
        self._slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self._slots[slots] = np.where(np.bincount(slots, minlength=1 << _SLOT_BITS)[slots] > 1, -2, np.arange(len(keys)))
        many = np.bincount([rank_of[s] for s in scores.values()])
        self._tied = many > 1  # ranks that several pieces share
        self._of = np.zeros(0x110000, np.int64)
        code = np.arange(0x110000)
        self._of[:] = self._base + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self._extra = np.zeros(int(self._width), np.int64)  # tokens beyond one that a symbol stands for
        for c, i in symbols.items():
            if len(c) == 1:
                self._of[ord(c)] = i
                if i >= n:
                    self._extra[i] = len(c.encode()) - 1
        for k in range(1, 5):
            self._extra[self._base + k] = k - 1
        self._alone = re.compile("([^" + re.escape("".join(sorted({c for p in pieces for c in p}))) + "])")
        self._limit, self._known = remember, {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or of its last (empty) row."""
        key = left * self._width + right
        at = self._slots[self._slot(key)]
        several = np.flatnonzero(at == -2)
        if len(several):
            at[several] = np.searchsorted(self._keys, key[several])
        return np.where(self._keys[at] == key, at, len(self._keys) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def merge(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none is empty)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        sym = self._of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        seq = np.repeat(np.arange(len(texts)), lengths)
        counts = np.zeros(len(texts), np.int64)
        while len(sym):
            same = np.append(seq[1:] == seq[:-1], False)
            at = self._pairs(sym, np.append(sym[1:], 0))
            rank = np.where(same, self._ranks[at], _NONE)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            done = low >= _NONE
            sizes = np.diff(np.append(starts, len(sym)))
            if done.any():
                over = np.repeat(done, sizes)
                np.add.at(counts, seq[over], 1 + self._extra[sym[over]])
                keep = ~over
                sym, seq, rank, at = sym[keep], seq[keep], rank[keep], at[keep]
                low, sizes = low[~done], sizes[~done]
                if not len(sym):
                    break
                starts = np.cumsum(sizes) - sizes
            each = np.repeat(low, sizes)
            hit = rank == each
            places = np.flatnonzero(hit)
            # Occurrences that overlap (x x x): every other one of a run, from its left.
            run = np.append(True, np.diff(places) != 1)
            first = places[np.flatnonzero(run)][np.cumsum(run) - 1]
            chosen = places[(places - first) % 2 == 0]
            new = self._made[at[chosen]]
            place_of = np.searchsorted(starts, chosen, side="right") - 1
            more = np.bincount(place_of, minlength=len(low)) > 1
            if more.any():
                stay = ~(self._risky(sym, seq, starts, chosen, new, low, place_of) & more)[place_of] | np.append(True, place_of[1:] != place_of[:-1])
                chosen, new = chosen[stay], new[stay]
            gone = np.zeros(len(sym), bool)
            sym[chosen] = new
            gone[chosen + 1] = True
            sym, seq = sym[~gone], seq[~gone]
        return counts

    def _risky(self, sym, seq, starts, chosen, new, low, place_of) -> np.ndarray:
        """Sequences where all occurrences at once could differ from one merge at a time."""
        risky = self._tied[low]
        ahead = np.minimum(chosen + 2, len(sym) - 1)
        within = (chosen + 2 < len(sym)) & (seq[ahead] == seq[chosen])
        after = self._ranks[self._pairs(new, np.where(within, sym[ahead], 0))]
        risky[place_of[within & (after < low[place_of])]] = True
        merged, touched, stay = sym.copy(), np.zeros(len(sym), bool), np.ones(len(sym), bool)
        merged[chosen], touched[chosen], stay[chosen + 1] = new, True, False
        left = np.flatnonzero(stay)
        a, b = left[:-1], left[1:]
        near = (seq[a] == seq[b]) & (touched[a] | touched[b])
        a, b = a[near], b[near]
        place = np.searchsorted(starts, a, side="right") - 1
        risky[place[self._ranks[self._pairs(merged[a], merged[b])] < low[place]]] = True
        return risky

    def _learn(self, lists: list[list[str]]) -> None:
        """Count the pre-tokens that are new, all together, in arrays of bounded size."""
        known = self._known
        if len(known) > self._limit:
            known.clear()
        new = list({p for words in lists for p in words if p not in known})
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and held < 300_000:
                held += len(new[end])
                end += 1
            known.update(zip(new[at:end], self.merge(new[at:end]).tolist(), strict=True))
            at = end

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """What is to be merged, and the number of tokens of characters that stand alone."""
        text = (SPACE + text).replace(" ", SPACE)
        parts = self._alone.split(text)
        alone = sum(len(c.encode("utf-8", "surrogatepass")) for c in parts[1::2])
        words: list[str] = []
        for part in parts[::2]:
            if not part:
                continue
            if SPACE * 2 in part or part.endswith(SPACE):
                words += re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", part)
            else:
                head, *tail = part.split(SPACE)
                words += [head] * bool(head)
                words += [SPACE + w for w in tail]
        return words, alone

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) if t else ([], 0) for t in texts]
        self._learn([words for words, _ in cut])
        return [alone + sum(map(self._known.__getitem__, words)) for words, alone in cut]


@lru_cache(maxsize=1)
def _counter(path: str) -> PieceCounter:
    """One per worker process, which keeps what it has counted from task to task."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            tokens, at = [], 0
            lengths = batch.column(1).to_pylist()
            while at < len(lengths):  # some MB of text at a time
                end, held = at, 0
                while end < len(lengths) and held < 4_000_000:
                    held += lengths[end]
                    end += 1
                tokens += counter.counts(batch.column(2).slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], schema=schema)

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
