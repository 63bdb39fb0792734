"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous array merging.

Words not met before wait in a batch. All of them are laid out as one ragged array of symbols; in each round every word
applies its lowest-ranked pair, at all its places at once. The symbols that survive are counted, with one for each UTF-8 byte
of a character that the vocabulary lacks. Documents then add up the counts of their words.

Cut into words: no piece of such a vocabulary has a space mark after another character, so merges never cross the start of
a run of marks. load() checks this and the model's kind, and raises where it doesn't hold.

Words of more than LONG characters go through a heap instead, one pair at a time: the arrays' rounds would cost the square of such
a length. The counts are the same.

Null text counts as empty: 0 tokens. Repeated rows are counted each. An empty table gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import slices, texts_of, with_columns

MARK = "▁"
NONE = np.int32(2**31 - 1)
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Longer words (in characters) go to a heap, whose cost doesn't grow with the square of the length.
LONG = 400
#: Words held by a Python worker; beyond, it starts anew.
HELD = 600_000


class PieceMerges:
    """Pair ranks of a sentencepiece BPE model as a hash table of numpy arrays."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("not a BPE model with plain normalisation and a mark before the text")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        pieces = {p.piece: p.score for p in model.pieces if p.type in (1, 5)}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches over the start of a word")
        falls_back = model.trainer_spec.byte_fallback
        # ids 1 to 4: a character that no piece has, of so many UTF-8 bytes
        ids: dict[str, int] = {}
        for p in pieces:
            for s in (p, *p):
                ids.setdefault(s, len(ids) + 5)
        self.cost = np.ones(len(ids) + 5, np.int64)
        self.char_id = np.repeat(np.array([1, 2, 3, 4], np.int32), [0x80, 0x780, 0xF800, 0x100000])
        if falls_back:
            self.cost[1:5] = [1, 2, 3, 4]
        for s, i in ids.items():
            if len(s) == 1:
                self.char_id[ord(s)] = i
                if s not in pieces and falls_back:
                    self.cost[i] = len(s.encode())
        ranks = {score: k for k, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, rank, to = [], [], []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    keys.append(ids[p[:k]] << 20 | ids[p[k:]])
                    rank.append(ranks[score])
                    to.append(ids[p])
        self.pairs = {k: (r, t) for k, r, t in zip(keys, rank, to, strict=True)}
        self._fill(np.array(keys, np.int64), np.array(rank, np.int32), np.array(to, np.int32))

    def _fill(self, keys, rank, to):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        size = 1 << self.bits
        self.keys, self.rank, self.to = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, the last stays
            won = self.keys[at] == keys[left]
            self.rank[at[won]], self.to[at[won]] = rank[left[won]], to[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a, b):
        """Rank and merged symbol of each pair; rank NONE where there is none."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        rank, to = self.rank[at], self.to[at]
        for _ in range(1, self.probes):
            miss = np.flatnonzero((found != keys) & (found >= 0))
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            found[miss] = self.keys[at[miss]]
            rank[miss], to[miss] = self.rank[at[miss]], self.to[at[miss]]
        rank[found != keys] = NONE
        return rank, to

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word carries its own space marks. Words may be of any length."""
        out = np.zeros(len(words), np.int64)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._by_heap(w)
        if short:
            out[short] = self._merged([words[k] for k in short])
        return out

    def _merged(self, words: list[str]) -> np.ndarray:
        sym = self.char_id[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        seq = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        out = np.zeros(len(words), np.int64)
        rank, to = self._pair_ranks(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            if (done := least == NONE).any():
                gone = np.repeat(done, sizes)
                out += np.bincount(seq[gone], self.cost[sym[gone]], len(words)).astype(np.int64)
                sym, seq, rank, to = sym[~gone], seq[~gone], rank[~gone], to[~gone]
                if not len(sym):
                    break
                least, sizes = least[~done], sizes[~done]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hit = rank == np.repeat(least, sizes)
            spot = np.arange(len(sym))
            # of overlapping places ("aaa") each second one, from the left
            hit &= (spot - np.maximum.accumulate(np.where(hit, -1, spot)) - 1) % 2 == 0
            at = np.flatnonzero(hit)
            new, of = to[at], seq[at]
            # a merge may make a pair that comes before the other places of the same rank: then only the first place is merged
            before = np.zeros(len(at), bool)
            ok = (at > 0) & (seq[at - 1] == of)
            before[ok] |= self.look(sym[at[ok] - 1], new[ok])[0] <= rank[at[ok]]
            after = np.minimum(at + 2, len(sym) - 1)
            ok = (at + 2 < len(sym)) & (seq[after] == of)
            before[ok] |= self.look(new[ok], sym[after[ok]])[0] <= rank[at[ok]]
            ok = np.flatnonzero((at[1:] == at[:-1] + 2) & (of[1:] == of[:-1]))
            before[ok] |= self.look(new[ok], new[ok])[0] <= rank[at[ok]]
            if before.any():
                first = np.r_[True, of[1:] != of[:-1]]
                stay = first | ~np.isin(of, of[before])
                at, new = at[stay], new[stay]
            sym[at], keep = new, np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            sym, seq, rank, to, touched = sym[keep], seq[keep], rank[keep], to[keep], touched[keep]
            touched[:-1] |= touched[1:]  # the pair on the left, whose first symbol may itself be merged
            t = np.flatnonzero(touched)
            rank[t], to[t] = self._ranks_at(sym, seq, t)
        return out

    def _pair_ranks(self, sym, seq):
        return self._ranks_at(sym, seq, np.arange(len(sym)))

    def _ranks_at(self, sym, seq, t):
        rank, to = np.full(len(t), NONE, np.int32), np.zeros(len(t), np.int32)
        ok = t + 1 < len(sym)
        ok[ok] = seq[t[ok]] == seq[t[ok] + 1]
        rank[ok], to[ok] = self.look(sym[t[ok]], sym[t[ok] + 1])
        return rank, to

    def _by_heap(self, word: str) -> int:
        """One word's tokens, the best pair at a time, leftmost first."""
        sym = self.char_id[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, pairs = len(sym), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def put(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := pairs.get(sym[i] << 20 | sym[j])):
                heapq.heappush(heap, (p[0], i, j, sym[i] << 20 | sym[j]))

        for i in range(n - 1):
            put(i, i + 1)
        while heap:
            _, i, j, key = heapq.heappop(heap)
            if sym[i] < 0 or sym[j] < 0 or after[i] != j or sym[i] << 20 | sym[j] != key:
                continue
            sym[i], sym[j] = pairs[key][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(before[i], i)
            put(i, after[i])
        return int(sum(self.cost[s] for s in sym if s >= 0))


@lru_cache(1)
def load(model_file: str) -> PieceMerges:
    return PieceMerges(model_file)


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first space mark, which every word has."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Counter:
    """Counts of texts; keeps the counts of words between batches."""

    def __init__(self, model_file: str):
        self.merges, self.held = load(model_file), {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [words_of(t) for t in texts]
        if len(self.held) > HELD:
            self.held.clear()
        new = list(set().union(*split) - self.held.keys())
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.held.update(zip(part, self.merges.counts([MARK + w for w in part]).tolist(), strict=True))
        return [sum(map(self.held.__getitem__, words)) for words in split]


@lru_cache(1)
def counter(model_file: str) -> Counter:
    """One for each Python worker, which runs many tasks."""
    return Counter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, without a shuffle.

    Memory is bounded by an Arrow batch, HELD words and the vocabulary's tables. model_file must be readable on each executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_file)
        for batch in slices(batches):
            texts = texts_of(batch)
            n = tokens(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
