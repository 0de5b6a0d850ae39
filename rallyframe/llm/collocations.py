"""Phrase collocation mining by hierarchical pair naming.

Texts become blocks: sequences of local word numbers with a table of the block's different words and their counts. Words are
counted over all blocks, and those that occur often enough get a global id, joined back to each block's table. A frequent
phrase of k words is then a pair of neighbouring, overlapping frequent phrases of k - 1 words: blocks emit their different
pairs of ids with counts, frequent pairs get a global id, and the ids joined back replace the pairs in the sequences. No
frequent phrase is missed, as its parts are no rarer. The two ids of a pair are its parents: along them a phrase finds the
counts of its beginnings and endings (for every cut) and marks the shorter phrases that it subsumes.

All shuffles carry rows that are aggregated within a block before (one for each different word or pair), so one very
common word or phrase is a row for each block, and joins are plain ones on names that are unique on one side. Nothing is
broadcast by the operator and nothing collected; a block's tables are bounded by ``BLOCK`` and the longest text.

Defined cases: a null text counts as empty; a null language counts as ``und``; ties are broken by cut, counts and phrase;
repeated rows count as often as they come; a text of any length is one sequence; an empty table, or one without frequent
phrases, gives no rows; other input columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.plans.scratch import stash, unstash

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes of text after which a block is closed.
BLOCK = 1 << 23
#: Pairs handed on at once.
PAIRS = 1 << 18
#: Parts in which each language's best rows are first found.
SLOTS = 64
#: The signs that end a piece, and a pattern of words and of runs of such signs.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")


class _Words:
    """The words of one language in an open block."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        tokens = _TOKENS.findall(text.lower())  # of bytes: A-Z only
        tokens.append(b"\n")
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))

    def closed(self) -> tuple[bytes, list[bytes], list[int]]:
        """The sequence (-1 where a piece ends), its words by number, their counts."""
        is_word = np.array([word[0] not in ENDS for word in self.numbers])
        number = np.where(is_word, np.cumsum(is_word) - 1, -1).astype(np.int32)
        sequence = number[np.concatenate(self.parts)]
        words = [word for word, own in zip(self.numbers, is_word, strict=True) if own]
        return sequence.tobytes(), words, np.bincount(sequence[sequence >= 0], minlength=len(words)).tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    def closed(open_: dict[str, _Words]) -> Iterator[pa.RecordBatch]:
        for lang, own in open_.items():
            sequence, words, counts = own.closed()
            arrays = [pa.array([lang]), pa.array([sequence], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "sequence", "words", "counts"])

    open_, size = defaultdict(_Words), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes()
            open_[lang.as_py()].add(raw)
            size += len(raw)
            if size >= BLOCK:
                yield from closed(open_)
                open_, size = defaultdict(_Words), 0
    yield from closed(open_)


def _recoded(block: pa.Scalar, sequence: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block whose sequence points into its ascending ids."""
    import pyarrow as pa

    arrays = [pa.array([block.as_py()], pa.int64()), pa.array([sequence.astype(np.int32).tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "sequence", "ids"])


def _named_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of word numbers as sequences of the words' ids."""
    for batch in batches:
        for block, sequence, named in zip(*(batch.column(c) for c in ("block", "sequence", "named")), strict=True):
            own = np.frombuffer(sequence.as_buffer(), np.int32)
            number, ids = (named.values.field(c).to_numpy() for c in ("number", "id"))
            order = np.argsort(ids)
            place = np.full(max(own.max(initial=-1), number.max(initial=-1)) + 2, -1, np.int32)  # the last one is for -1
            place[number[order]] = np.arange(len(order))
            yield _recoded(block, place[own], ids[order])


def _neighbours(sequence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose own and next element are named, and one number for each such pair."""
    at = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
    return at, sequence[at].astype(np.int64) * n + sequence[at + 1]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of neighbours of each block, and how often they occur in it."""
    import pyarrow as pa

    for batch in batches:
        for block, sequence, named in zip(*(batch.column(c) for c in ("block", "sequence", "ids")), strict=True):
            ids = named.values.to_numpy()
            codes, counts = np.unique(_neighbours(np.frombuffer(sequence.as_buffer(), np.int32), len(ids))[1], return_counts=True)
            for start in range(0, len(codes), PAIRS):
                own = codes[start : start + PAIRS]
                columns = [np.full(len(own), block.as_py(), np.int64), ids[own // len(ids)], ids[own % len(ids)], counts[start : start + PAIRS]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "left", "right", "n"])


def _named_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of ids as sequences of the ids of their pairs."""
    for batch in batches:
        for block, sequence, own_ids, named in zip(*(batch.column(c) for c in ("block", "sequence", "ids", "named")), strict=True):
            own, ids = np.frombuffer(sequence.as_buffer(), np.int32), own_ids.values.to_numpy()
            left, right, made = (named.values.field(c).to_numpy() for c in ("left", "right", "id"))
            codes = np.searchsorted(ids, left).astype(np.int64) * len(ids) + np.searchsorted(ids, right)
            by_code, by_id = np.argsort(codes), np.argsort(made)
            place = np.empty(len(made), np.int32)
            place[by_id] = np.arange(len(made))
            at, met = _neighbours(own, len(ids))
            found = np.minimum(np.searchsorted(codes[by_code], met), len(codes) - 1)
            hit = codes[by_code][found] == met
            after = np.full(max(len(own) - 1, 0), -1, np.int32)
            after[at[hit]] = place[by_code][found[hit]]
            yield _recoded(block, after, made[by_id])


RECODED = "block long, sequence binary, ids array<long>"


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10**14."""
    wide = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def _counted(named: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Frequent pairs of the phrases ``named``: id, parents, lang, phrase, its last word, a, and the counts of its beginnings and endings by length."""
    left = named.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("__phrase"), F.concat("starts", F.array("a")).alias("starts"))
    right = named.select(F.col("id").alias("right"), "last", F.concat("ends", F.array("a")).alias("ends"))
    found = counts.where(F.col("a") >= least).join(left, "left").join(right, "right")
    phrase = F.concat_ws(" ", "__phrase", "last").alias("phrase")
    return found.select(F.monotonically_increasing_id().alias("id"), "left", "right", "lang", phrase, "last", "a", "starts", "ends")


def mine(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, part: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best ``top`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    least: occurrences of a candidate. part: a longer candidate with at least so many hundredths of a's occurrences subsumes it.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = texts.mapInArrow(_blocks, "lang string, sequence binary, words array<string>, counts array<long>")
    blocks = stash(blocks.withColumn("block", F.monotonically_increasing_id()), "words")
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = stash(totals, "totals")

    items = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select("block", "number", "lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    words = items.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    none = F.array().cast("array<long>")
    named = stash(words.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("starts"), none.alias("ends")), "names")
    back = items.join(named.select("lang", "phrase", "id"), ["lang", "phrase"]).groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("named"))
    coded = stash(blocks.select("block", "sequence").join(back, "block").mapInArrow(_named_words, RECODED), "coded")
    unstash(blocks)

    levels = []
    for k in range(2, most_words + 1):
        pairs = coded.mapInArrow(_pairs, "block long, left long, right long, n long")
        named = stash(_counted(named, pairs.groupBy("left", "right").agg(F.sum("n").alias("a")), least), "names")
        levels.append(named)
        if k < most_words:
            back = pairs.join(named.select("left", "right", "id"), ["left", "right"]).groupBy("block").agg(F.collect_list(F.struct("left", "right", "id")).alias("named"))
            after = stash(coded.join(back, "block").mapInArrow(_named_pairs, RECODED), "coded")
            unstash(coded)
            coded = after
    unstash(coded)

    kept = []
    for k, own in enumerate(levels):
        cuts = F.transform(F.arrays_zip("starts", F.reverse("ends").alias("ends")), lambda x, at: F.struct(_score(F.col("a"), x["starts"], x["ends"]).alias("score"), at.alias("cut"), x["starts"].alias("l"), x["ends"].alias("r")))
        if k + 1 < len(levels):  # a phrase inside a longer one lies inside one that is a word longer and no rarer
            longer = levels[k + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            own = own.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < part * F.col("a")))
        kept.append(own.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    found = kept[0]
    for more in kept[1:]:
        found = found.union(more)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slotted = found.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)))
    best = slotted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
