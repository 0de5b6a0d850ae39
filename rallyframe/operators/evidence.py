"""Claims of several sources about one thing: votes per field, one-to-one boards, candidates by similar names, nested contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def reconciled(existing: DataFrame, claims: DataFrame, key: str, witness: str, never: str | None = None, most: int = 500_000) -> DataFrame:
    """One verdict for each (key, field) that some source claims: key, field, value (where staged), verdict, sources, families.

    existing: (key, field, value) known already. claims: (key, row, family, field, value), row being one source's row for the key.
    A claim that differs from a known value, or is not finite, taints its whole row. A field whose claims differ is disputed,
    whoever makes them, also tainted rows. A key with any conflict is contested: its fields need an untainted claim of the
    family ``witness`` and one of another family (``never`` does not count as one). Nothing is decided by majority.

    Verdicts: known (all claims agree with the known value), conflict (one does not), disputed, tainted (no untainted
    claim), uncorroborated (contested and lacking witnesses), staged. A claim without a value is none. Every step is a
    grouped aggregate by key and field, row or key, so no key's claims are gathered. The claims are counted first and dealt
    to tasks of about ``most``, so that a task's memory does not grow with them.
    """
    n = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(claims.count(), existing.count()) // most))
    valid = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    known = existing.where(F.col("value").isNotNull()).repartition(n, key, "field").groupBy(key, "field").agg(F.min("value").alias("known"))
    met = claims.where("value IS NOT NULL").repartition(n, key, "field").join(known, [key, "field"], "left")
    met = met.withColumn("clash", ~valid | F.coalesce(F.abs(F.col("value") - F.col("known")) > TOLERANCE, F.lit(False))).repartition(n, key, "row")
    rows = met.groupBy(key, "row").agg(F.max("clash").alias("tainted"))
    told = met.join(rows, [key, "row"])
    open_, clean = F.col("known").isNull() & ~F.col("clash"), ~F.col("tainted")
    another = F.col("family") != witness if never is None else ~F.col("family").isin(witness, never)
    fields = told.repartition(n, key, "field").groupBy(key, "field").agg(
        F.max("clash").alias("clash"), F.first("known", True).alias("known"), F.min(F.when(open_, F.col("value"))).alias("low"), F.max(F.when(open_, F.col("value"))).alias("high"),
        F.count_if(open_ & clean).alias("sources"), F.count_if(open_ & clean & (F.col("family") == witness)).alias("witnesses"), F.count_if(open_ & clean & another).alias("others"),
        F.count_distinct(F.when(open_ & clean, F.col("family"))).alias("families"),
    )
    fields = fields.withColumn("disputed", F.coalesce(F.col("high") - F.col("low") > TOLERANCE, F.lit(False))).repartition(n, key)
    contested = fields.groupBy(key).agg(F.max(F.col("clash") | F.col("disputed")).alias("contested"))
    verdict = (
        F.when(F.col("known").isNotNull(), F.when(F.col("clash"), "conflict").otherwise("known"))
        .when(F.col("disputed"), "disputed")
        .when(F.col("sources") == 0, F.when(F.col("clash") & F.col("low").isNull(), "conflict").otherwise("tainted"))
        .when(F.col("contested") & ((F.col("witnesses") == 0) | (F.col("others") == 0)), "uncorroborated")
        .otherwise("staged")
    )
    out = fields.join(contested, key).withColumn("verdict", verdict)
    return out.select(key, "field", F.when(F.col("verdict") == "staged", F.col("low")).alias("value"), "verdict", "sources", "families")


def board_match(board: DataFrame, fixtures: DataFrame, board_id: str, fixture_id: str, time: str, stages: list[tuple[str, int]]) -> DataFrame:
    """One row for each board row: board_id, fixture_id (where matched), stage and diagnosis.

    stages: (key column on both sides, seconds of tolerance), strictest first. A board row takes the first stage in which any
    fixture lies within its tolerance; it must be one fixture there (else ``ambiguous``), and no other board row may have
    come to the same one (else ``contested``). Diagnoses: matched, ambiguous, contested, unmatched, unusable (no id, time or
    first key). Rows that repeat id, time and keys count once; ids that come with different times or keys are different
    rows, and contest each other.

    Each stage is an interval join: both sides are dealt to slots of its tolerance and a board row looks into three, so a
    key with many fixtures meets only those near it in time.
    """
    keys = [k for k, _ in stages]
    usable = F.col(board_id).isNotNull() & F.col(time).isNotNull() & F.col(keys[0]).isNotNull()
    rows = board.select(board_id, time, *keys).distinct().withColumn("__row", F.xxhash64(board_id, time, *keys))
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    found, left = None, rows.where(usable)
    for at, (key, most) in enumerate(stages):
        mine = left.where(F.col(key).isNotNull()).select("__row", board_id, time, *keys, seconds.alias("__t"))
        mine = mine.withColumn("__slot", F.explode(F.array(*[F.floor(F.col("__t") / most) + d for d in (-1, 0, 1)])))
        theirs = fixtures.where(F.col(fixture_id).isNotNull()).select(F.col(fixture_id), F.col(key), seconds.alias("__u")).distinct().withColumn("__slot", F.floor(F.col("__u") / most))
        near = mine.join(theirs, [key, "__slot"]).where(F.abs(F.col("__t") - F.col("__u")) <= most)
        got = near.groupBy("__row", board_id).agg(F.min(fixture_id).alias("__low"), F.max(fixture_id).alias("__high")).withColumn("stage", F.lit(at + 1))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("__row"), "__row", "left_anti")
    one = found.withColumn(fixture_id, F.when(F.col("__low") == F.col("__high"), F.col("__low")))
    taken = one.where(F.col(fixture_id).isNotNull()).groupBy(fixture_id).agg(F.count("*").alias("__n"))
    twice = one.where(F.col(fixture_id).isNotNull()).groupBy(board_id).agg(F.count("*").alias("__m"))
    judged = one.join(taken, fixture_id, "left").join(twice, board_id, "left").select("__row", fixture_id, "stage", "__n", "__m")
    out = rows.join(judged, "__row", "left")
    diagnosis = (
        F.when(~usable, "unusable").when(F.col("stage").isNull(), "unmatched").when(F.col(fixture_id).isNull(), "ambiguous").when((F.col("__n") > 1) | (F.col("__m") > 1), "contested").otherwise("matched")
    )
    return out.select(board_id, F.col(time), F.when(diagnosis == "matched", F.col(fixture_id)).alias(fixture_id), "stage", diagnosis.alias("diagnosis"))


#: Cyrillic and Greek letters as Latin ones, in natural order.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r",
    "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ϊ": "i", "ΐ": "i", "ό": "o", "ύ": "y", "ϋ": "y", "ΰ": "y", "ώ": "o",
}


def latin(name: Column) -> Column:
    """Lower case in Latin letters: Cyrillic and Greek letters transliterated, common accents dropped, words joined by one blank."""
    from rallyframe.functions.values import folded

    text = F.lower(F.coalesce(name, F.lit("")))
    for letter, plain in (CYRILLIC | GREEK).items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return folded(text)


def _deletions(text: Column, most: int) -> Column:
    """A text and all it becomes by leaving out up to ``most`` letters."""
    out = one = F.array(text)
    for _ in range(most):
        one = F.array_distinct(F.flatten(F.transform(one, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t)))))))
        out = F.array_union(out, one)
    return out


def similar_names(source: DataFrame, target: DataFrame, id_col: str, name: str, block: str, vetoes: list[str], edits: int = 2, least: int = 8) -> DataFrame:
    """Candidate pairs of a source and a target row of one block: source, target, evidence (exact, initials, edits), distance and score (4, 2, 1).

    exact: equal Latin forms; initials: equal first letter and last word; edits: forms of at least ``least`` letters within
    ``edits`` insertions, deletions or changes. A veto column with different values on both sides rules a pair out.

    Forms within so many edits share a form that both become by leaving out as many letters, so these neighbourhoods are
    the join keys: no pair is missed and none is met without a reason. The names of a block are first reduced to different
    forms; rows come back after forms have met.
    """
    def rows(df: DataFrame, side: str) -> DataFrame:
        form = latin(F.col(name))
        return df.select(F.col(id_col).alias(side), F.col(block).alias("block"), form.alias("form"), *[F.col(v).alias(f"{side}_{v}") for v in vetoes]).where("form <> ''")

    a, b = rows(source, "source"), rows(target, "target")
    keyed = lambda df: df.select("block", "form").distinct().withColumn("initials", F.concat_ws(" ", F.substring("form", 1, 1), F.element_at(F.split("form", " "), -1)))
    fa, fb = keyed(a), keyed(b)
    long_enough = lambda df: df.where(F.length("form") >= least).select("block", F.col("form"), F.explode(_deletions(F.col("form"), edits)).alias("near"))
    close = long_enough(fa).join(long_enough(fb).withColumnRenamed("form", "other"), ["block", "near"]).select("block", "form", "other").distinct()
    close = close.withColumn("distance", F.levenshtein("form", "other")).where(F.col("distance") <= edits)
    alike = fa.join(fb.select("block", F.col("form").alias("other"), "initials"), ["block", "initials"]).select("block", "form", "other", F.levenshtein("form", "other").alias("distance"))
    evidence = F.when(F.col("form") == F.col("other"), "exact").when(F.max("__i") == 1, "initials").otherwise("edits")
    pairs = close.withColumn("__i", F.lit(0)).unionByName(alike.withColumn("__i", F.lit(1))).groupBy("block", "form", "other", "distance").agg(evidence.alias("evidence"))
    met = pairs.join(a, ["block", "form"]).join(b.withColumnRenamed("form", "other"), ["block", "other"])
    for v in vetoes:
        met = met.where(F.coalesce(F.col(f"source_{v}") == F.col(f"target_{v}"), F.lit(True)))
    score = F.when(F.col("evidence") == "exact", 4).when(F.col("evidence") == "initials", 2).otherwise(1)
    return met.select("source", "target", "evidence", "distance", score.alias("score"))


def merged_context(left: Column, right: Column, first: list[str], atomic: list[str], resolved: tuple[str, str] | None = None) -> Column:
    """Two nested contexts (maps of maps of texts) as one, by rules per key.

    first: the left section stays if it is there. atomic: the right section replaces the left one whole. resolved: (section,
    flag): the left section stays if its flag is ``true``, else the right one replaces it if it is there and not empty.
    Other sections are merged entry by entry, the right one winning unless its value is null or empty. Null maps count as
    empty. Merging the same right side again changes nothing.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,string>>"))

    def entries(a: Column, b: Column) -> Column:
        return F.map_zip_with(a, b, lambda _, x, y: F.when(y.isNull() | (y == ""), x).otherwise(y))

    def section(key: Column, a: Column, b: Column) -> Column:
        both = F.when(a.isNull(), b).when(b.isNull(), a)
        keep = F.when(key.isin(first), a) if first else F.when(F.lit(False), a)
        if atomic:
            keep = keep.when(key.isin(atomic), b)
        if resolved:
            name, flag = resolved
            keep = keep.when((key == name) & F.coalesce(a[flag] == "true", F.lit(False)), a).when((key == name) & (F.size(b) > 0), b).when(key == name, a)
        return F.coalesce(both, keep.otherwise(entries(a, b)))

    return F.map_zip_with(F.coalesce(left, none), F.coalesce(right, none), section)


POINTS = "served0 INT, won0 INT, served1 INT, won1 INT"


def point_tape(tape: Column, least: int = 8) -> Column:
    """A tape of points folded into a struct (served0, won0, served1, won1, games, error): each side's points on serve and those won.

    S and A are points of the server, R and D of the receiver; ``;`` and ``.`` end a game and, if it had a point, turn the
    service; ``/`` turns it within a tie-break game; blanks are skipped. error: empty, turn_without_point, unknown_sign,
    too_few_points, one_sided; null for a sound tape. The first error counts; counts are null with an error.
    """
    signs = F.split(F.regexp_replace(F.coalesce(tape, F.lit("")), r"\s+", ""), "")
    zero = F.lit(0)
    start = F.struct(zero.alias("server"), F.lit(False).alias("played"), *[zero.alias(c) for c in ("served0", "won0", "served1", "won1", "games")], F.lit(None).cast("string").alias("error"))

    def step(s: Column, sign: Column) -> Column:
        point, kept, turn = sign.isin("S", "A", "R", "D"), sign.isin("S", "A"), sign == "/"
        over = sign.isin(";", ".") & s["played"]
        known = point | turn | sign.isin(";", ".", "")
        error = F.coalesce(s["error"], F.when(turn & ~s["played"], "turn_without_point").when(~known, "unknown_sign"))
        count = lambda c, side, when: (s[c] + F.when(when & (s["server"] == side), 1).otherwise(0)).alias(c)
        return F.struct(
            F.when(over | turn, 1 - s["server"]).otherwise(s["server"]).alias("server"),
            F.when(point, True).when(over, False).otherwise(s["played"]).alias("played"),
            count("served0", 0, point), count("won0", 0, kept), count("served1", 1, point), count("won1", 1, kept),
            (s["games"] + F.when(over, 1).otherwise(0)).alias("games"), error.alias("error"),
        )

    def judged(s: Column) -> Column:
        error = F.when(F.trim(F.coalesce(tape, F.lit(""))) == "", "empty").otherwise(
            F.coalesce(s["error"], F.when(s["served0"] + s["served1"] < least, "too_few_points").when((s["served0"] == 0) | (s["served1"] == 0), "one_sided"))
        )
        return F.struct(*[F.when(error.isNull(), s[c]).alias(c) for c in ("served0", "won0", "served1", "won1", "games")], error.alias("error"))

    return F.aggregate(signs, start, step, judged)


def point_links(points: DataFrame, matches: DataFrame, aliases: DataFrame, keys: list[str], sides: tuple[str, str], match_id: str, point_id: str, rates: tuple[str, str], known: tuple[str, str], near: float = 0.02) -> DataFrame:
    """One row for each row of ``points``: point_id, match_id, first, second and reason.

    Both tables name two sides in any order; aliases (alias, name) are resolved on both. A row links if exactly one match has
    its ``keys`` and pair of names; first and second are then its ``rates`` turned to the match's sides. Reasons: unusable (a side
    missing or both the same), unmatched, ambiguous, conflict (a rate differs from a ``known`` one by more than ``near``),
    present (both known already), linked. Pairs are counted before rows meet, so an ambiguous pair is no product of rows.
    """
    names = aliases.groupBy("alias").agg(F.min("name").alias("name"), F.count_distinct("name").alias("__k")).where("__k = 1").drop("__k")

    def resolved(df: DataFrame) -> DataFrame:
        for at, side in enumerate(sides):
            df = df.join(names.select(F.col("alias").alias(side), F.col("name").alias(f"__n{at}")), side, "left").withColumn(f"__n{at}", F.coalesce(f"__n{at}", side))
        return df.withColumns({"__low": F.least("__n0", "__n1"), "__high": F.greatest("__n0", "__n1")})

    on = [*keys, "__low", "__high"]
    theirs = resolved(matches).where("__n0 <> __n1").groupBy(*on).agg(
        F.count("*").alias("__m"), F.min(match_id).alias(match_id), F.min("__n0").alias("__first"), *[F.min(c).alias(f"__known{k}") for k, c in enumerate(known)]
    )
    met = resolved(points).join(theirs, on, "left")
    usable, turned = F.coalesce(F.col("__n0") != F.col("__n1"), F.lit(False)), F.col("__n0") != F.col("__first")
    first, second = (F.when(turned, F.col(rates[1 - k])).otherwise(F.col(rates[k])) for k in (0, 1))
    clash = F.lit(False)
    for k, value in enumerate((first, second)):
        clash = clash | F.coalesce(F.abs(F.col(f"__known{k}") - value) > near, F.lit(False))
    reason = (
        F.when(~usable, "unusable").when(F.col("__m").isNull(), "unmatched").when(F.col("__m") > 1, "ambiguous").when(clash, "conflict")
        .when(F.col("__known0").isNotNull() & F.col("__known1").isNotNull(), "present").otherwise("linked")
    )
    linked = reason == "linked"
    return met.select(point_id, F.when(linked, F.col(match_id)).alias(match_id), F.when(linked, first).alias("first"), F.when(linked, second).alias("second"), reason.alias("reason"))
