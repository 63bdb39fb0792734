"""Vector best-fit packing of documents into token sequences.

Each document becomes its token ids and one end id, cut into pieces only where it is longer than a sequence. A sequence has
three capacities: tokens, pieces and attention cost (the sum of squared piece lengths). Pieces are dealt longest first; each
goes to the open sequence that is best under every constraint, by the norm of what would be left or by the weighted dot
product of its demand and what is left, else to a new sequence.

What a piece asks for depends on its length alone, so the packing is worked out for the whole corpus on the counts of each
length (at most one row for each possible length): sequences in the same state are one class with a count, and pieces of one
length fill the sequences of a class at once, as if dealt one by one. The plan is a table of intervals: so many pieces of a length, from such a rank, go to sequences
numbered from here at that offset. Its size depends on the sequence length, not on the corpus. Pieces then find their place by
their rank among those of their length: a running number within the task that made them, plus the counts of earlier tasks.

Pieces of one length differ in nothing that counts; they are dealt by task and by row. Of sequences that are equally good, those
of the state that came up first are taken. Null text counts as empty: one piece of the end id. Repeated rows and equal doc_ids are packed each. An empty table gives no
rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept, slices, sole, texts_of, with_columns

#: Pre-tokens held by a Python worker; beyond, it starts anew.
HELD = 500_000
APART = "\x02"
#: Bytes that no plain word has. Plain words are of printable ASCII and U+00C0 to U+00FF: they are in normal form C, and their
#: lower case doesn't depend on what is around.
NOT_PLAIN = np.array([b < 0x21 or b == 0x7F or b >= 0xC0 and b != 0xC3 for b in range(256)])
#: The tokenizer's pre-tokens, for plain words in lower case; a line is a word.
PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
#: The signs of bytes that have none of their own, in the tokenizer's byte alphabet.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: What PARTS and PLAIN stand for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


@dataclass
class Ragged:
    """Id lists, one after another; list k is ids[cuts[k] : cuts[k + 1]]."""

    ids: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(lists: list[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(lists), "<u4"), np.r_[0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4)])

    def then(self, other: Ragged) -> Ragged:
        return Ragged(np.r_[self.ids, other.ids], np.r_[self.cuts, other.cuts[1:] + len(self.ids)])

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists in a row, and where each ends."""
        sizes = np.diff(self.cuts)[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.cuts[at] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.ids[places], ends


class WordIds:
    """Ids of whole texts from the ids of their words, for a tokenizer that normalizes and splits as the constants above say: its
    pre-tokens never span white space. A file of another kind is an error."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        told = json.loads(self.tokenizer.to_str())
        have = [(told[k] or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if have != [NORMALIZERS, [SPLIT, BYTES]] or told["truncation"] or told["padding"] or any(not t["content"].startswith("<|") for t in told["added_tokens"]):
            raise ValueError(f"{file} does not normalize and split as WordIds does")
        self.model = self.tokenizer.model
        #: Ids of pre-tokens, and of words that are not plain.
        self.parts, self.others = {"\n": b""}, {}
        (self.apart,) = self._ids(APART)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _through(self, words: list[str]) -> None:
        """Words that aren't plain go through the whole tokenizer, many at once, with a sign between them that is a token of its own."""
        ids = np.array(self._ids(f" {APART} ".join(words)), "<u4")
        cuts = np.flatnonzero(ids == self.apart)
        if len(cuts) == len(words) - 1 and not any(APART in w for w in words):
            self.others.update(zip(words, map(bytes, np.split(ids.view(np.uint8), np.stack([cuts * 4, cuts * 4 + 4], 1).ravel())[::2]), strict=True))
        else:
            self.others.update((w, np.array(self._ids(w), "<u4").tobytes()) for w in words)

    def _rest(self, words: list[str]) -> list[bytes]:
        if len(self.others) > HELD:
            self.others.clear()
        new = [w for w in words if w not in self.others]
        for k in range(0, len(new), 5000):
            self._through(new[k : k + 5000])
        return [self.others[w] for w in words]

    def _plain(self, words: pa.Array) -> Ragged:
        """Plain words are cut into pre-tokens all at once, and only new pre-tokens go to the merges, without what the library does
        to trace places in a text."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        found = pa.array(PARTS.findall(joined), pa.string()).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        if len(self.parts) > HELD:
            self.parts = {"\n": b""}
        parts, tokenize = self.parts, self.model.tokenize
        for part in distinct:
            if part not in parts:
                mapped = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_SIGNS)
                parts[part] = array("I", [t.id for t in tokenize(mapped)]).tobytes()
        of = found.indices.to_numpy()
        each = Ragged.of([parts[x] for x in distinct])
        ids, ends = each.taken(of)
        cuts = np.flatnonzero(of == distinct.index("\n")) if len(words) > 1 else np.zeros(0, np.int64)
        return Ragged(ids, np.r_[0, ends[cuts], len(ids)])

    def _ids_of(self, texts: list[str], lower: bool) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return [b""] * len(texts)
        odd = np.ones(len(words), bool)
        if lower:
            raw, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            odd = np.diff(np.r_[0, np.cumsum(NOT_PLAIN[raw])][at]) > 0
            odd |= pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        known = Ragged.of(self._rest(words.take(pa.array(rest)).to_pylist()))
        if len(plain):
            known = self._plain(words.take(pa.array(plain))).then(known)
        place = np.empty(len(words), np.int64)
        place[np.r_[plain, rest]] = np.arange(len(words))
        ids, ends = known.taken(place[coded.indices.to_numpy()])
        cuts = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in pairwise(cuts)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out, narrow, wide = [b""] * len(texts), {}, {}
        for k, t in enumerate(texts):
            low = t.lower()
            try:
                # of Latin-1's letters none changes with what is around, so lower case may come first
                low.encode("latin-1")
                narrow[k] = low
            except UnicodeEncodeError:
                wide[k] = t
        for of, lower in ((narrow, True), (wide, False)):
            if of:
                for k, ids in zip(of, self._ids_of(list(of.values()), lower), strict=True):
                    out[k] = ids
        return out


def word_ids(file: str) -> WordIds:
    return sole(("word ids", file), lambda: WordIds(file))


@dataclass(frozen=True)
class Limits:
    """What a sequence holds, and how an open one is chosen.

    rule: "norm" takes the least weighted norm of the residual after placing, "dot" the greatest weighted dot product of the
    piece's demand and the residual before, both as shares of the capacities. weights: of tokens, pieces and attention.
    """

    tokens: int = 2048
    pieces: int | None = None
    attention: int | None = None
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)

    def __post_init__(self):
        if self.rule not in ("norm", "dot") or self.tokens < 1 or (self.pieces or 1) < 1 or (self.attention or 1) < 1:
            raise ValueError("limits must be positive and the rule norm or dot")

    def capacity(self) -> np.ndarray:
        """Without a limit of their own, pieces and attention get the least one that can't bind."""
        return np.array([self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(lengths: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence, offset): those ranks go to as many successive sequences.

    All three residuals count in the choice, also where a capacity cannot bind.
    """
    full, weights = limits.capacity(), np.array(limits.weights)
    states, counts, ranges, slot = np.zeros((64, 3), np.int64), np.zeros(64, np.int64), [], {}
    out, opened = [], 0

    def put(state, first: int, n: int) -> None:
        nonlocal states, counts
        k = slot.get(key := tuple(state.tolist()))
        if k is None:
            k = slot[key] = len(ranges)
            if k == len(counts):
                states, counts = np.concatenate([states, np.zeros_like(states)]), np.concatenate([counts, np.zeros_like(counts)])
            states[k] = state
            ranges.append(deque())
        if ranges[k] and sum(ranges[k][-1]) == first:
            ranges[k][-1] = (ranges[k][-1][0], ranges[k][-1][1] + n)
        else:
            ranges[k].append((first, n))
        counts[k] += n

    for length, left in sorted(lengths.items(), reverse=True):
        need, rank = np.array([length, 1, length**2], np.int64), 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            m = len(ranges)
            free = np.flatnonzero((counts[:m] > 0) & (states[:m] >= need).all(1))
            if len(free):
                had = states[free] / full
                score = ((had - need / full) ** 2 * weights).sum(1) if limits.rule == "norm" else -(had * (need / full) * weights).sum(1)
                k = free[np.argmin(score)]
                state, first, n = states[k].copy(), *ranges[k].popleft()
                # by norm a sequence that took a piece is best for the next as well; by dot product it comes after its like
                deep = min(left, int((state // need).min())) if limits.rule == "norm" else 1
                if n > left // deep:
                    ranges[k].appendleft((first + left // deep, n - left // deep))
                    n = left // deep
                counts[k] -= n
            else:
                # a new sequence is filled before the next is opened
                state, first, deep = full, opened, min(left, int((full // need).min()))
                n = left // deep
                opened += n
            out += [(length, rank + j * n, n, first, int(full[0] - state[0]) + j * length) for j in range(deep)]
            put(state - deep * need, first, n)
            rank, left = rank + deep * n, left - deep * n
    return out


def pieces_of(docs: DataFrame, tokenizer_file: str, tokens: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the task that made it and its number there among its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = word_ids(tokenizer_file), TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches, 8192):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(texts_of(batch)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    one = ids[at : at + 4 * tokens]
                    n = len(one) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(one), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are read and tokenized once; the pieces (no text) are kept in the shared folder. The driver gets a count for each
    length that occurs, at most limits.tokens rows.
    """
    most = int(min(limits.tokens, limits.capacity()[2] ** 0.5))
    pieces = kept(pieces_of(docs, tokenizer_file, most, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(plan(total, limits) or np.zeros((0, 5)), np.int64)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    held = pieces.sparkSession.sparkContext.broadcast(steps)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = held.value
        # ranks stay below 2**44
        keys = steps[:, 0] << 44 | steps[:, 1]
        for batch in slices(batches, 1 << 16, "length"):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            of = steps[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(of[:, 3] + rank - of[:, 1]), pa.array(of[:, 4])], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(before, ["part", "length"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
