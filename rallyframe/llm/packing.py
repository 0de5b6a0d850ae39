"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece may be shorter). The
plan works on the counts per length, at most ``capacity`` numbers however many documents there are: from the longest
length down, the gap it leaves is looked up in an index of the lengths, of the sums of two and of three, under the counts
still available, and every combination that fills a gap exactly is used as often as the counts allow; what remains is
placed by best fit, again by whole counts. Each piece then finds its sequence by its number within its length. Pieces of
one length are dealt out in turn to as many slots as their number asks for, so one very common length, or one id, never
meets in one task.

Defined cases: a null text counts as empty (its one closing token makes a piece of length 1); very long texts are
tokenised whole; rows that repeat an id are packed separately (their pieces carry the same id); a null id is kept; an
empty table gives an empty table; input columns other than id and text are not read.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.plans.scratch import stash

#: Parts into which the pieces of one length are split: so many at least, and more for more than so many rows in each.
SLOTS, SLOT_ROWS = 64, 250_000

def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(others)}


class _Ids:
    """Ids of texts, as little-endian unsigned 32-bit integers, of a byte-level BPE vocabulary with its rule for pre-tokens.

    A vocabulary whose merges make one token each, in the order of their ids, has the ids of its ranks, which a rank-based
    encoder finds much faster; others, and texts that hold a special token's string, go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str, special: tuple[str, ...]):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.special = Tokenizer.from_file(path), special
        stored = json.loads(self.tokenizer.to_str())
        vocab, letters = stored["model"]["vocab"], {letter: byte for byte, letter in _byte_letters().items()}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in stored["model"]["merges"]]
        if all(a < b for a, b in pairwise(made)) and stored["normalizer"] is None:
            added = {x["content"] for x in stored["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): at for token, at in vocab.items() if token not in added}
            self.ordinary = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.ordinary = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # special tokens are cut out before pre-tokens
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self.ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def _ids(path: str, pattern: str, special: tuple[str, ...]) -> _Ids:
    """One a worker, which goes on to other tasks."""
    return _Ids(path, pattern, special)


def _tokenised(batches: Iterator[pd.DataFrame], path: str, pattern: str, special: tuple[str, ...], capacity: int, end: int, keep_ids: bool) -> Iterator[pd.DataFrame]:
    ids, closing, turn = _ids(path, pattern, special), np.array([end], "<u4").tobytes(), 0
    for batch in batches:
        rows = []
        for at, text in zip(batch["id"], batch["text"], strict=True):
            raw = ids.encode(text) + closing
            n = len(raw) // 4
            start, stop, piece = 0, (n - 1) % capacity + 1, 0
            while start < n:
                own = raw[4 * start : 4 * stop]
                rows.append((at, piece, start, stop - start, zlib.crc32(own), own if keep_ids else None, turn))
                start, stop, piece, turn = stop, stop + capacity, piece + 1, turn + 1
        yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids", "turn"]).astype({"id": "Int64"})


class _Sums:
    """Available lengths by the sums of one, two and three of them.

    Counts only fall, so what a sum's list has passed over for good is never looked at again.
    """

    def __init__(self, left: np.ndarray, least: int):
        self.left, self.least = left, least
        self.lengths = [int(x) for x in np.flatnonzero(left)[::-1] if x >= least]
        self.pairs: dict[int, list[int]] = {}
        self.thirds: dict[int, list[int]] = {}

    def free(self, length: int, used: tuple[int, ...]) -> bool:
        return self.left[length] > used.count(length)

    def one(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if gap >= self.least and self.free(gap, used) else None

    def two(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths with this sum, the larger as large as can be."""
        if gap not in self.pairs:
            a = np.arange((gap + 1) // 2, gap - self.least + 1)
            self.pairs[gap] = a[(self.left[a] > 0) & (self.left[gap - a] > 0)].tolist()
        own = self.pairs[gap]
        while own and not (self.left[own[-1]] and self.left[gap - own[-1]]):
            own.pop()
        for a in reversed(own):
            if self.free(a, used) and self.free(gap - a, (*used, a)):
                return a, gap - a
        return None

    def three(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """Three lengths with this sum, the largest as large as can be."""
        if gap not in self.thirds:
            self.thirds[gap] = [x for x in reversed(self.lengths) if 3 * x >= gap and x <= gap - 2 * self.least]
        own = self.thirds[gap]
        while own and not self.left[own[-1]]:
            own.pop()
        for a in reversed(own):
            if self.free(a, used) and (pair := self.two(gap - a, (*used, a))):
                return (a, *pair)
        return None


Filling = tuple[tuple[tuple[int, int], ...], int]


def _exact(left: np.ndarray, capacity: int, least: int) -> list[Filling]:
    """Fill gaps exactly with lengths of at least ``least``, from the longest length down; ``left`` keeps what remains."""
    made, sums = [], _Sums(left, least)
    for length in range(capacity, least - 1, -1):
        while left[length] > 0:
            gap, used = capacity - length, (length,)
            fill = () if gap == 0 else sums.one(gap, used) or sums.two(gap, used) or sums.three(gap, used)
            if fill is None:
                break
            parts = (length, *fill)
            times = {p: parts.count(p) for p in parts}
            n = min(int(left[p]) // k for p, k in times.items())
            for p, k in times.items():
                left[p] -= n * k
            made.append((tuple(times.items()), n))
    return made


def _best_fit(left: np.ndarray, capacity: int) -> list[Filling]:
    """Best fit from the longest length down, by whole counts: open sequences by their gap."""
    open_: dict[int, list[Filling]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    open_.setdefault(capacity - fit * length, []).append((((length, fit),), full))
                if rest:
                    open_.setdefault(capacity - rest * length, []).append((((length, rest),), 1))
                n = 0
                continue
            parts, have = open_[gap].pop()
            take = min(have, n)
            if have > take:
                open_[gap].append((parts, have - take))
            if not open_[gap]:
                del open_[gap]
            times = dict(parts)
            times[length] = times.get(length, 0) + 1
            open_.setdefault(gap - length, []).append((tuple(times.items()), take))
            n -= take
    return [x for at in open_.values() for x in at]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Filling, bool]]:
    """Fillings (((length, times), ...), number of sequences that get it), and whether the index of sums made it. counts: pieces by length.

    Exact fills use up short pieces that best fit could have put into many gaps, so the plan is made for several least
    lengths of an exact fill (the last leaves all to best fit), and the one with the fewest sequences is taken.
    """
    best, fewest = [], None
    for least in (1, capacity // 128 + 1, capacity // 32 + 1, capacity // 8 + 1, capacity // 4 + 1, capacity + 1):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        made = [(f, True) for f in _exact(left, capacity, least)] + [(f, False) for f in _best_fit(left, capacity)]
        if fewest is None or sum(n for (_, n), _ in made) < fewest:
            best, fewest = made, sum(n for (_, n), _ in made)
    return best


def _placed(batches: Iterator[pd.DataFrame], table: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Sequence and place of each piece: its length and number find the filling whose numbers hold it."""
    for batch in batches:
        key = batch["length"].to_numpy() * (1 << 48) + batch["number"].to_numpy()
        at = np.searchsorted(table["key"], key, "right") - 1
        beyond = key - table["key"][at]
        times = table["times"][at]
        batch["sequence_id"] = table["first"][at] + beyond // times
        batch["exact"] = table["exact"][at].astype(bool)
        batch["offset"] = table["offset"][at] + beyond % times * batch["length"].to_numpy()
        yield batch.drop(columns=["number"])


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",), capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, ids (null unless keep_ids; little-endian unsigned 32-bit), sequence_id, exact (whether the index of sums filled the sequence) and offset.

    The tokenizer is a byte-level BPE; pattern is its rule for pre-tokens. special: strings it takes for tokens. end: the id that closes a document.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = stash(texts.mapInPandas(lambda it: _tokenised(it, tokenizer_path, pattern, special, capacity, end, keep_ids), schema + ", turn long"), "pieces")

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    keys, first, offsets, repeats, exact = [], [], [], [], []
    given, sequences = dict.fromkeys(counts, 0), 0
    for (parts, n), by_index in plan(counts, capacity):
        at = 0
        for length, times in parts:
            keys.append(length * (1 << 48) + given[length])
            first.append(sequences)
            offsets.append(at)
            repeats.append(times)
            exact.append(by_index)
            given[length] += n * times
            at += length * times
        sequences += n
    order = np.argsort(np.array(keys, np.int64))
    table = {k: np.array(v, np.int64)[order] for k, v in (("key", keys), ("first", first), ("offset", offsets), ("times", repeats), ("exact", exact))}

    slots = max(SLOTS, -(-max(counts.values(), default=0) // SLOT_ROWS))
    slotted = pieces.withColumn("slot", F.pmod("turn", F.lit(slots)))
    sizes = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slot").orderBy("id", "piece", "ids_crc32", "turn")
    numbered = slotted.withColumn("own", F.row_number().over(within)).join(sizes, ["length", "slot"]).withColumn("number", F.col("before") + F.col("own") - 1)
    placed = numbered.select("id", "piece", "start", "length", "ids_crc32", "ids", "number").mapInPandas(lambda it: _placed(it, table), schema + ", sequence_id long, exact boolean, offset long")
    empty = pieces.drop("turn").withColumns({"sequence_id": F.lit(0).cast("long"), "exact": F.lit(False), "offset": F.lit(0).cast("long")})
    return (placed if sequences else empty).withColumnRenamed("id", id_col)
