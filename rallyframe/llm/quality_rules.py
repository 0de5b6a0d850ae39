"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio of every document.

N-grams are pairs of neighbouring words and pairs of neighbouring word shapes (runs of small letters, capitals and digits as
one sign each, other signs as they are). Every n-gram is hashed to a bucket, none is left out or treated apart for being
rare; the number of buckets is a power of two that follows the square root of the corpus's bytes (``PER_ROOT`` buckets for each
byte of the root, ``MOST`` at most), so that a task's own counts are never more rows than buckets. Two smoothed multinomials over the buckets are counted on whole texts: the trusted target (documents whose
ids are given as trusted) and the raw corpus (all documents). A document's score is the mean over its n-grams of
log(target / raw), its own n-grams left out of either count; one below ``THRESHOLD`` is rejected. Texts are read once: the
counted rules and each text's buckets with their counts are written, and counting and scoring read these. The corpus's counts
are a table whose rows hold 1024 buckets each; it is broadcast at every size, as ``MOST`` bounds it to 1 GB.

Defined cases: a null or blank text has no words and fails the base rules; with no trusted documents, an empty corpus or
nothing left beside a document all its ratios are 0 and only the base rules decide; rows alike in text and trust are
scored alike; input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.text import SPACES, words
from rallyframe.plans.scratch import sized_join, stash, unstash

#: Buckets of n-grams for each byte of the square root of the corpus's bytes; buckets at least and at most.
PER_ROOT, LEAST, MOST = 8, 1 << 12, 1 << 26
#: Bits of a bucket's number that are its place in a row of the table.
ROW_BITS = 10
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.02
#: Occurrences in the raw corpus, of which the target has its share, that are added to each bucket's.
SMOOTHING = 64
#: Letters and digits that a word's shape shows as one sign for a run of them.
SHAPES = [(r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")]
#: Bits of a packed window that hold its place in the text.
PLACE_BITS = 20
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _pairs(values: Column) -> Column:
    """A hash for each pair of neighbours."""
    n = F.size(values)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), lambda a, b: F.xxhash64(a, b)))


def _windows(hashes: Column, pairs: Column) -> Column:
    """A hash for each window of three words. hashes: one per word; pairs: one per pair of neighbours."""
    n = F.size(hashes)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(pairs, 1, n - 2), F.slice(hashes, 3, n - 2), lambda a, b: F.xxhash64(a, b)))


def _seen_twice(windows: Column) -> Column:
    """Ascending places of the windows that occur twice or more; null if none does.

    A window's hash and its place share one long (44 + 20 bits), so sorting brings equal windows together as plain longs;
    equal neighbours are then compared by their full hashes. Where neighbours share the 44 bits but not the hash, and in
    texts of over a million words, pairs of hash and place are sorted instead: the result is the same.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    place = lambda e: e.bitwiseAND(low).cast("int")
    same = lambda a, b: F.get(windows, place(a)) == F.get(windows, place(b))
    n = F.size(windows)
    # for neighbours in order: the pair's two places if their windows share the 44 bits, and whether they are equal
    met = lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0, F.struct(F.array(place(a), place(b)).alias("at"), same(a, b).alias("same")))
    twos = F.filter(F.zip_with(F.slice(packed, 1, n - 1), F.slice(packed, 2, n - 1), met), F.isnotnull)
    wide = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = F.filter(F.zip_with(F.slice(wide, 1, n - 1), F.slice(wide, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), F.isnotnull)
    quick = lambda ts: F.when(F.forall(ts, lambda t: t["same"]), F.transform(ts, lambda t: t["at"])).otherwise(slow)
    repeats = F.size(F.array_distinct(windows)) < n
    return F.when(repeats, F.sort_array(F.array_distinct(F.flatten(F.when(n <= 1 << PLACE_BITS, let(twos, quick)).otherwise(slow)))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where the optimizer moves the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(text: Column, more: Callable[[Column], list[Column]] = lambda _: []) -> Column:
    """The counted rules of a text as a struct of ``BASE``, and ``more`` made of the hashes of its pairs of neighbouring words."""

    def rules(ws: Column, pairs: Column, at: Column, lines: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        covered = F.when(at.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda x, y: x + y)).cast("long")
        whole = F.coalesce(text, F.lit(""))
        n = F.size(ws).cast("long")
        return let(
            covered,
            lambda repeated: F.struct(
                n.alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.when(F.rlike(whole, F.lit(SYMBOLS)), F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                ((n < 50) | (100 * repeated > 50 * n)).alias("base_failed"),
                *more(pairs),
            ),
        )

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(words(text), lambda ws: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(_pairs(hs), lambda ps: let(_windows(hs, ps), lambda win: let(_seen_twice(win), lambda at: let(lines, lambda ls: rules(ws, ps, at, ls)))))))


def _shaped(text: Column) -> Column:
    """The text with each word as its shape; words stay apart."""
    for runs, sign in SHAPES:
        text = F.regexp_replace(text, runs, sign)
    return text


def _runs(values: Column, buckets: int) -> Column:
    """(b, k): the bucket of each different hash and how often it occurs."""
    low = F.lit(buckets - 1).cast("long")

    def bound(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        return let(starts, lambda at: F.zip_with(at, F.slice(at, 2, F.size(at)), lambda i, j: F.struct(F.get(own, i).bitwiseAND(low).cast("int").alias("b"), (F.coalesce(j, F.size(own)) - i).alias("k"))))

    none = F.array().cast("array<struct<b:int,k:int>>")
    return F.when(F.size(values) == 0, none).otherwise(let(F.sort_array(values), bound))


def _once_and_often(pairs: Column, shapes: Column, buckets: int) -> Column:
    """A struct of once (the bucket of each hash that occurs once), often (b and k of the others) and n (all occurrences).

    Pairs of words mostly occur once, and are told apart by set operations; pairs of shapes hardly ever do.
    """
    low = F.lit(buckets - 1).cast("long")

    def split(own: Column) -> Column:
        # every occurrence of a hash but its first
        again = F.array_compact(F.zip_with(F.slice(own, 2, F.size(own)), own, lambda b, a: F.when(a == b, b)))
        return let(again, lambda more: F.struct(F.transform(F.array_except(own, more), lambda h: h.bitwiseAND(low).cast("int")).alias("once"), F.transform(_runs(more, buckets), lambda r: F.struct(r["b"].alias("b"), (r["k"] + 1).alias("k"))).alias("often")))

    words_ = F.when(F.size(pairs) > 0, let(F.sort_array(pairs), split))
    none = F.array().cast("array<int>")
    return let(words_, lambda w: F.struct(F.coalesce(w["once"], none).alias("once"), F.concat(F.coalesce(w["often"], F.array().cast("array<struct<b:int,k:int>>")), _runs(shapes, buckets)).alias("often"), (F.size(pairs) + F.size(shapes)).cast("long").alias("n")))


@dataclass
class Ratios:
    """Counts of the buckets (__row, __raw and __target, an array of 2^ROW_BITS buckets each), how many buckets, and the totals."""

    counts: DataFrame
    buckets: int
    raw: int
    target: int


def bucket_count(size: int) -> int:
    """Buckets for a corpus of so many bytes."""
    return min(MOST, max(LEAST, 1 << max(0, math.isqrt(size) * PER_ROOT - 1).bit_length()))


def featured(docs: DataFrame, trusted: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None) -> tuple[DataFrame, int]:
    """A written table of ``docs`` (its columns ``more``, by default all but those that ``judge`` adds), and how many buckets it uses.

    Further columns: __id (unique), __of (1 for rows whose id is among ``trusted``, else 0), __v (the counted rules), __once and __often
    (the buckets of the n-grams that the text holds once, and b and k of the others) and __n (n-grams).
    """
    left = [c for c in (docs.columns if more is None else more) if c not in (*BASE, "llr", "kept")]
    n = buckets or bucket_count(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    ids = trusted.select(id_col).distinct().withColumn("__of", F.lit(1))
    flagged = sized_join(docs.select(*{*left, text_col, id_col}), ids, [id_col], "left", ids.count())
    text = F.col(text_col)
    shapes = let(words(_shaped(text)), _pairs)
    grams = lambda pairs: [let(shapes, lambda hs: _once_and_often(pairs, hs, n)).alias("grams")]
    made = flagged.select(*left, F.coalesce("__of", F.lit(0)).alias("__of"), F.monotonically_increasing_id().alias("__id"), counted(text, grams).alias("__v"))
    table = made.select(*left, "__of", "__id", F.struct(*[F.col(f"__v.{c}").alias(c) for c in BASE]).alias("__v"), F.col("__v.grams.once").alias("__once"), F.col("__v.grams.often").alias("__often"), F.col("__v.grams.n").alias("__n"))
    return stash(table, "featured"), n


def _exploded(features: DataFrame, *columns: str) -> DataFrame:
    """A row (``columns``, __b, __k) for each n-gram of each row."""
    once = features.select(*columns, F.explode("__once").alias("__b"), F.lit(1).alias("__k"))
    often = features.select(*columns, F.explode("__often").alias("g")).select(*columns, F.col("g.b").alias("__b"), F.col("g.k").alias("__k"))
    return once.union(often)


def ratio_table(features: DataFrame, buckets: int) -> Ratios:
    """The counts over all rows of a ``featured`` table."""
    grams = _exploded(features, "__of").select(F.col("__b").cast("long").alias("__b"), "__k", (F.col("__k") * F.col("__of")).alias("__t"))
    every = features.sparkSession.range(buckets).select(F.col("id").alias("__b"), F.lit(0).alias("__k"), F.lit(0).alias("__t"))  # also buckets that nothing is in
    counts = grams.union(every).groupBy("__b").agg(F.sum("__k").alias("__raw"), F.sum("__t").alias("__target"))
    rows = counts.groupBy(F.shiftright("__b", ROW_BITS).alias("__row")).agg(F.sort_array(F.collect_list(F.struct("__b", "__raw", "__target"))).alias("c"))
    table = stash(rows.select("__row", F.col("c.__raw").alias("__raw"), F.col("c.__target").alias("__target")), "ratios")
    total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y))
    raw, target, most = table.agg(total("__raw"), total("__target"), F.max(F.array_max("__raw"))).first()
    kind = "array<int>" if most < 1 << 31 else "array<long>"
    return Ratios(table.select("__row", F.col("__raw").cast(kind).alias("__raw"), F.col("__target").cast(kind).alias("__target")), buckets, raw, target)


def scores(features: DataFrame, ratios: Ratios, among: bool = True) -> DataFrame:
    """(__id, llr) of every row with n-grams. among: whether the rows are among those counted, so that their own counts are left out."""
    met = _exploded(features, "__of", "__id", "__n").join(F.broadcast(ratios.counts), F.shiftright("__b", ROW_BITS).cast("long") == F.col("__row"))
    place, less = F.col("__b").bitwiseAND(F.lit((1 << ROW_BITS) - 1)), F.col("__k") if among else F.lit(0)
    all_own = F.col("__n") if among else F.lit(0)
    raw, target = ratios.raw - all_own, ratios.target - all_own * F.col("__of")
    in_raw, in_target = F.get("__raw", place), F.get("__target", place)
    # log(target / raw) of the bucket, less that of all: one logarithm of the four factors
    ratio = F.log((in_target - less * F.col("__of") + SMOOTHING * target / raw) * raw / ((in_raw - less + SMOOTHING) * target))
    ratio = F.when((raw > 0) & (target > 0), ratio).otherwise(0.0)
    return met.groupBy("__id", "__n").agg(F.sum(F.col("__k") * ratio).alias("__sum")).select("__id", (F.col("__sum") / F.col("__n")).alias("llr"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, more: list[str] | None = None, ratios: Ratios | None = None, written: bool = False) -> DataFrame:
    """Every row of ``docs`` with the columns of ``BASE``, llr (mean log ratio; null below two words) and kept.

    trusted: ids (column ``id_col``) of the target's documents. more: the input columns to keep, by default all. ratios: counts of
    another corpus; by default those of ``docs``, where a document's own counts are left out of its ratios. written: write the
    result at once and delete the tables that it was made from.
    """
    features, n = featured(docs, trusted, ratios.buckets if ratios else None, id_col, text_col, more)
    counts = ratios or ratio_table(features, n)
    found = scores(features, counts, among=ratios is None)
    judged = features.drop("__of", "__once", "__often", "__n").join(found, "__id", "left")
    kept = ~F.col("__v.base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    left = [c for c in features.columns if c not in ("__of", "__id", "__v", "__once", "__often", "__n")]
    out = judged.select(*left, *[F.col(f"__v.{c}").alias(c) for c in BASE], "llr", kept.alias("kept"))
    if written:
        out = stash(out, "judged")
        unstash(features, *([] if ratios else [counts.counts]))
    return out
