"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are whole runs of 16 or more key characters, or of 6 or more right after an assignment to a secret word, each
occurrence with the text before it. Features: length, character transitions
(changes of class between neighbours), dictionary coverage (the share of characters in words that the corpus itself uses
often, see ``dictionary``, and of placeholders), the path the text came from, and the neighbouring words. A forest is
trained on labelled findings (by default ``labelled_findings``, whose harmless ones hold words of the dictionary) and
compiled into one column expression, so scanning and redacting are each one pass of DataFrame functions without a shuffle.

Defined cases: null and empty texts hold no candidates; texts are scanned whole; a candidate that occurs several times in
a text is one finding at its first place, with the highest score of all its places; rows that repeat an id give each their findings; a null path is an unknown path;
an empty table gives an empty table; input columns other than id, text and path are not read by ``scan`` and kept as they
are by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.quality_rules import let

#: Characters in front of a candidate that count as its neighbourhood.
BEFORE = 48
#: Words that name secrets.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "auth", "bearer"]
#: A candidate: a whole run of key characters (possessive, so a run is tried once); shorter ones only as the value of a secret word.
_KEY, _SET = r"[A-Za-z0-9+/_\-]", r"[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
RUN = rf"(?<!{_KEY})(?:{_KEY}{{16,}}+|(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{'|'.join(SECRET_WORDS)}){_SET}){_KEY}{{6,15}}+(?!{_KEY}))"
#: Words that name harmless identifiers.
HARMLESS_WORDS = ["sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "etag", "revision", "build", "version", "fingerprint"]
#: Words of the corpus that a dictionary holds, and the fewest letters of one.
WORDS, LETTERS = 2000, 4
#: Words that stand for a value in examples and templates.
PLACEHOLDERS = ["example", "sample", "changeme", "placeholder", "your", "here", "test", "dummy", "redacted", "secret", "password", "token", "default", "value", "insert", "key", "user", "name", "local", "host"]
#: Parts of paths that hold examples.
EXAMPLE_PATHS = ["test", "example", "sample", "docs", "fixture", "mock"]
FEATURES = ["f_length", "f_letter_digit", "f_case", "f_digits", "f_upper", "f_hex", "f_vowel_pairs", "f_longest_letters", "f_placeholder", "f_dictionary", "f_example_path", "f_secret_word", "f_harmless_word", "f_assigned", "f_known_prefix"]
#: Labelled findings at most that a forest is trained on.
MOST_LABELLED = 20_000
TREES, DEPTH, SEED = 16, 6, 7
LEAST_SCORE = 0.5


def _any(words: list[str]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def dictionary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[str]:
    """The ``words`` most frequent lower-case words of at least ``LETTERS`` letters, counted over all whole texts; ties by code point."""
    own = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z]+"), lambda w: (F.length(w) >= LETTERS) & (F.length(w) <= 24) & (w == F.lower(w)))
    counts = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(words).collect())


def features(c: Column, before: Column, path: Column, known: list[str] | None = None) -> list[Column]:
    """``FEATURES`` of a candidate, the text in front of it and the path. known: a ``dictionary``."""
    n = F.length(c)
    share = lambda pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))) / n
    yes = lambda column, pattern: F.rlike(column, F.lit(pattern)).cast("double")
    near = F.right(before, F.lit(24))
    made = {
        "f_length": n.cast("double"),
        "f_letter_digit": share(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "f_case": share(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_hex": yes(c, "^[0-9a-f]+$"),
        "f_vowel_pairs": share(r"(?i)[bcdfghjklmnpqrstvwxz](?=[aeiouy])"),
        "f_longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)).cast("double"),
        "f_placeholder": 1 - F.length(F.regexp_replace(c, _any(PLACEHOLDERS), "")) / n,
        "f_dictionary": F.aggregate(F.filter(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda w: F.lower(w).isin(known or PLACEHOLDERS)), F.lit(0), lambda n, w: n + F.length(w)) / n,
        "f_example_path": yes(F.coalesce(path, F.lit("")), _any(EXAMPLE_PATHS)),
        "f_secret_word": yes(near, _any(SECRET_WORDS)),
        "f_harmless_word": yes(near, _any(HARMLESS_WORDS)),
        "f_assigned": yes(before, r"[=:]\s*[\"']?$"),
        "f_known_prefix": yes(c, "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[bap]-|^sk_live_|^AIza"),
    }
    return [made[name].alias(name) for name in FEATURES]


def labelled_findings(spark: SparkSession, known: list[str] | None = None, each: int = 250, first: int = 0) -> DataFrame:
    """(candidate, before, path, label): findings of known kinds with digests as their random part, ``each`` of a kind.

    known: a ``dictionary``, of whose words harmless findings are made besides syllables. first: the first random number.
    """
    hexes = F.concat(F.md5(F.concat(F.lit("a"), F.col("id"))), F.md5(F.concat(F.lit("b"), F.col("id"))))
    alnum = lambda k: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512))), "[+/=]", "x")
    upper = lambda k: F.translate(F.upper(alnum(k)), "0189", "2345")
    syllables = F.array(*[F.lit(x) for x in ("an", "der", "tion", "en", "th", "ung", "re", "ció", "er", "lich", "on", "heit", "ment", "ou", "es", "keit", "in", "ado")])
    word = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), 4 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)).cast("int")), lambda i: F.get(syllables, F.pmod(F.xxhash64("id", F.lit(k), i), F.lit(18)).cast("int"))), "")
    plain = lambda k: F.translate(word(k), "ó", "o")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64("id", F.lit("p")), F.lit(len(xs))).cast("int"))
    listed = F.lit([w for w in known or PLACEHOLDERS if w.isascii()])
    of_corpus = lambda k: F.get(listed, F.pmod(F.xxhash64("id", F.lit(k)), F.size(listed)).cast("int"))
    kinds = [
        (F.concat_ws("_", of_corpus("a"), of_corpus("b"), of_corpus("c")), pick("", "token = ", "call ", "secret: "), 0),
        (F.concat_ws("/", of_corpus("d"), of_corpus("e"), F.substring(hexes, 1, 3)), pick("/", "see ", "key=", "path: "), 0),
        (F.concat(of_corpus("f"), F.initcap(of_corpus("g")), F.initcap(of_corpus("h")), F.pmod(F.xxhash64("id"), F.lit(90)).cast("string")), pick("", "token: ", "the ", "password = "), 0),
        (F.concat_ws("-", of_corpus("i"), of_corpus("j"), of_corpus("k")), pick("", "id ", "auth/", "of "), 0),
        (F.concat(F.lit("AKIA"), F.substring(upper("k"), 1, 16)), pick("", "and ", "key ", "of the "), 1),
        (F.concat(F.lit("ghp_"), F.substring(alnum("g"), 1, 36)), pick("", "token = ", "use "), 1),
        (F.substring(hexes, 1, 40), pick('token = "', 'secret = "', 'api_key: "', "auth token "), 1),
        (F.substring(hexes, 3, 18), pick("password=", "passwd = ", 'pwd: "', "secret="), 1),
        (F.substring(alnum("s"), 1, 32), pick('secret_key = "', "access_key=", "bearer ", 'password: "'), 1),
        (F.substring(hexes, 1, 40), pick("commit ", "revision ", "sha1 = ", "checksum: "), 0),
        (hexes, pick("sha256 ", "digest: ", "fingerprint ", 'etag "'), 0),
        (F.substring(hexes, 2, 32), pick("md5 ", "md5: ", "build ", "uuid "), 0),
        (plain("w"), pick("", "the ", "of ", "password ", "und "), 0),
        (F.concat_ws("_", plain("v"), plain("u")), pick("", "token = ", "call ", "the "), 0),
        (F.concat_ws("/", plain("x"), plain("y")), pick("/", "see ", "://", "path: "), 0),
        (F.concat_ws("-", plain("y"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("string")), pick("", "id ", "/", "page "), 0),
        (F.lpad(F.pmod(F.xxhash64("id", F.lit("n")), F.lit(10**16)).cast("string"), 16, "4"), pick("", "was ", "number ", "card "), 0),
        (F.concat(pick("your_", "example_", "test_", "sample_"), F.lit("password_here")), pick("password=", "token = ", 'secret: "'), 0),
        (F.substring(hexes, 5, 10), pick("password = ", "pwd=", 'secret: "', 'token = "'), 1),
        (F.concat(F.substring(plain("w"), 1, 6), F.pmod(F.xxhash64("id"), F.lit(900)).cast("string")), pick("password = ", "passwd=", 'pwd: "', "secret="), 1),
        (F.substring(alnum("t"), 1, 12), pick("password=", 'secret = "', "token: ", "api_key="), 1),
        (F.substring(plain("z"), 1, 12), pick("password = ", "token: ", 'secret: "', "auth="), 0),
        (pick("changeme", "your_key", "example1", "test_token", "dummy123", "placeholder", "password1", "sample_key"), pick("password=", "token = ", 'secret: "'), 0),
        (F.concat(F.lit("AKIA"), F.rpad(pick("EXAMPLEKEY", "SAMPLE", "TESTDUMMY"), 16, "EXAMPLE")), pick("key ", "aws_access_key_id = "), 0),
    ]
    ids = spark.range(first, first + each, 1, 1)
    out = None
    for k, (candidate, before, label) in enumerate(kinds):
        path = pick("src0", "src3", "lib/main.py", "src7") if label or k < 16 else pick("docs/readme", "test/config", "src1", "example/app")
        part = ids.select(candidate.alias("candidate"), before.alias("before"), path.alias("path"), F.lit(label).alias("label"))
        out = part if out is None else out.union(part)
    return out


@dataclass
class Forest:
    """A trained forest and the dictionary of its features."""

    model: RandomForestClassificationModel
    known: list[str]

    def features(self, c: Column, before: Column, path: Column) -> list[Column]:
        return features(c, before, path, self.known)


def train(labelled: DataFrame, known: list[str] | None = None, most: int = MOST_LABELLED) -> Forest:
    """A forest on at most ``most`` labelled findings (candidate, before, path, label 0 or 1), those of the least hashes; incomplete rows are left out."""
    rows = labelled.where("candidate is not null and label is not null").select("candidate", "before", "path", "label")
    rows = rows.orderBy(F.xxhash64("candidate", "before", "path", "label"), "candidate").limit(most)
    rows = rows.select(*features(F.col("candidate"), F.coalesce("before", F.lit("")), F.col("path"), known), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="5", labelCol="label", featuresCol="features")
    return Forest(forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1))), known or PLACEHOLDERS)


def forest_of(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> Forest:
    """A forest with the dictionary of ``docs``. labelled: findings (candidate, before, path, label 0 or 1) of the caller's; without any, ``labelled_findings``."""
    known = dictionary(docs, text_col)
    return train(labelled_findings(docs.sparkSession, known) if labelled is None else labelled, known)


def _tree(node, row: Column) -> Column:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / max(sum(stats), 1e-12)))
    split = node.split()
    return F.when(row[FEATURES[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), row)).otherwise(_tree(node.rightChild(), row))


def score(forest: Forest, row: Column) -> Column:
    """The forest as one expression over a struct of ``FEATURES``: the mean over its trees of the share of secrets in the leaf."""
    total = F.lit(0.0)
    for tree in forest.model.trees:
        total = total + _tree(tree._java_obj.rootNode(), row)
    return total / len(forest.model.trees)


def findings(forest: Forest, text: Column, path: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the stretches between candidates and of the (start, candidate, score) of every occurrence, in order.

    The score is the highest of all places of the candidate in the text.
    """

    def scored(gaps: Column, runs: Column) -> Column:
        # each step binds what the next one uses, so nothing is evaluated twice
        sizes = F.zip_with(F.slice(gaps, 1, F.size(runs)), runs, lambda g, c: F.struct(F.length(g).alias("g"), F.length(c).alias("c")))
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n["g"] + n["c"])))
        placed = let(ends, lambda at: F.transform(runs, lambda c, i: F.struct(c.alias("c"), (F.get(at, i + 1) - F.length(c)).alias("at"))))
        seen = F.transform(placed, lambda p: F.struct(p["c"].alias("c"), p["at"].alias("at"), F.substring(text, F.greatest(p["at"] - BEFORE, F.lit(0)) + 1, F.least(p["at"], F.lit(BEFORE))).alias("b")))
        made = F.transform(seen, lambda p: F.struct(p["c"].alias("c"), p["at"].alias("at"), F.struct(*forest.features(p["c"], p["b"], path)).alias("f")))
        each = F.transform(made, lambda p: F.struct(p["at"].cast("long").alias("start"), p["c"].alias("candidate"), score(forest, p["f"]).alias("score")))
        best = lambda ps, c: F.array_max(F.transform(F.filter(ps, lambda p: p["candidate"] == c), lambda p: p["score"]))
        top = let(each, lambda ps: let(F.transform(F.array_distinct(runs), lambda c: F.struct(c.alias("c"), best(ps, c).alias("s"))), lambda ds: F.transform(ps, lambda p: F.struct(p["start"].alias("start"), p["candidate"].alias("candidate"), F.get(F.filter(ds, lambda d: d["c"] == p["candidate"]), F.lit(0))["s"].alias("score")))))
        return let(top, lambda ps: body(gaps, ps))

    return let(F.split(text, RUN, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda runs: scored(gaps, runs)))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per candidate: the id, start (of its first occurrence), candidate, score and is_secret."""
    rows = docs.where(F.rlike(F.col(text_col), F.lit(RUN)))
    first = lambda _, ps: let(F.transform(ps, lambda p: p["candidate"]), lambda cs: F.filter(ps, lambda p, i: F.array_position(cs, p["candidate"]) == i + 1))
    found = rows.select(F.col(id_col).alias("__id"), F.explode(findings(forest, F.col(text_col), F.col(path_col).cast("string"), first)).alias("__f"))
    return found.select(F.col("__id").alias(id_col), "__f.start", "__f.candidate", "__f.score", (F.col("__f.score") >= least_score).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, mark: str = "[SECRET]", text_col: str = "text", path_col: str = "source", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with every occurrence of every secret replaced by ``mark``, by place; no row moves."""
    text = F.col(text_col)
    masked = lambda gaps, ps: F.array_join(F.zip_with(gaps, ps, lambda g, p: F.concat(g, F.when(p["score"] >= least_score, F.lit(mark)).otherwise(F.coalesce(p["candidate"], F.lit(""))))), "")
    clean = findings(forest, text, F.col(path_col).cast("string"), masked)
    return docs.withColumn(text_col, F.when(F.rlike(text, F.lit(RUN)), clean).otherwise(text))
