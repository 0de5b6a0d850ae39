"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A document's terms are its words (hashed), runs of three characters by class (small and capital letters, digits, blanks,
line breaks, each common mark, other bytes) and one term for each of a few graded traits (length, share of different words,
of words that repeat the one before, of repeated lines, of capitals, of marks). Weighted by log frequency and inverse
document frequency they are projected on the first ``DIMENSIONS`` singular vectors of the labelled sample. Those unit vectors
are broadcast (at most ``2 * SAMPLE`` of them), each block of documents is multiplied by all of them in double precision, and
the ``NEAREST`` neighbours vote with their label, weighted by a power of the cosine. Ties at the last place (to nine places)
all vote, so results don't depend on any order.

The sample: the different labelled texts with the least hashes, at most ``SAMPLE`` of each label. Hashes are compared first
and only the sample's texts are read as texts, in tasks; the driver gets their terms. Labels serve only as labels; ids,
language and source are no input. Whole texts count.

Defined cases: null and empty texts have only trait terms and get a score; labels other than 0 and 1 are not learnt from;
with one label only, all scores are that label's; without labels, or on an empty table, every score is 0.5 or there are no
rows; rows that repeat are scored alike and learnt from once for each label; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shingles import word_hashes
from rallyframe.plans.scratch import stash

SAMPLE, DIMENSIONS, NEAREST, SHARPNESS, ROWS, SEED = 3000, 32, 25, 8.0, 512, 17
_CLASSES = 24
_GRAMS = _CLASSES**3
_GRADES = 8
_TRAITS = 6
#: Buckets of hashed words.
WORDS = 4096
TERMS = _GRAMS + _TRAITS * _GRADES + WORDS
#: Weight of a trait's term beside the weights of all runs, which have norm 1.
TRAIT_WEIGHT = 0.5
#: Weight of all words beside the weights of all runs.
WORD_WEIGHT = 0.3
#: Sampled texts from which the singular vectors are taken, at most.
FITTED = 3000


def _class_table() -> np.ndarray:
    table = np.full(256, 1, np.uint8)  # other marks
    table[128:] = 2
    for at, own in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"-_", b":;", b"\"'", b"()[]{}", b"/\\")):
        table[list(own)] = at + 3
    return table


_TABLE = _class_table()


def _grade(share: float) -> int:
    return min(int(share * _GRADES), _GRADES - 1)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's terms, before inverse document frequency."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _TABLE[raw].astype(np.int32)
    places, weights = np.zeros(0, np.int64), np.zeros(0)
    if len(kinds) >= 3:
        grams = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
        counts = np.bincount(grams, minlength=_GRAMS)
        places = np.flatnonzero(counts)
        weights = np.log1p(1000.0 * counts[places] / len(grams))
    words = word_hashes(text)
    n = len(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    letters = int(((kinds == 3) | (kinds == 4)).sum())
    traits = [
        min(int(np.log2(n + 1) / 1.5), _GRADES - 1),
        _grade(len(np.unique(words)) / n) if n else 0,
        _grade(float((words[1:] == words[:-1]).mean())) if n > 1 else 0,
        _grade(1 - len(set(lines)) / len(lines)) if lines else 0,
        _grade(float((kinds == 4).sum()) / letters) if letters else 0,
        _grade(min(4.0 * float(((kinds != 2) & (kinds != 3) & (kinds != 4) & (kinds != 6) & (kinds != 7)).mean()), 1.0)) if len(kinds) else 0,
    ]
    kinds_of_words, times = np.unique(words % np.uint64(WORDS), return_counts=True)
    places = np.concatenate((places, [_GRAMS + t * _GRADES + g for t, g in enumerate(traits)], kinds_of_words.astype(np.int64) + _GRAMS + _TRAITS * _GRADES))
    return places, np.concatenate((weights, np.ones(_TRAITS), np.log1p(1000.0 * times / max(n, 1))))


def weighted(places: np.ndarray, weights: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights with inverse document frequency; runs, traits and words each with their norm."""
    own = weights * idf[places]
    word, trait = places >= _GRAMS + _TRAITS * _GRADES, (places >= _GRAMS) & (places < _GRAMS + _TRAITS * _GRADES)
    for part, norm in ((~word & ~trait, 1.0), (word, WORD_WEIGHT)):
        own[part] *= norm / max(float(np.linalg.norm(own[part])), 1e-12)
    own[trait] = TRAIT_WEIGHT
    return own


class Model:
    """Inverse document frequencies, the projection, and unit vectors with their labels. made: ``terms`` of the sampled texts."""

    def __init__(self, made: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        self.labels = np.array(labels, float)
        self.idf, self.axes, self.vectors = np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1))
        if not len(made):
            return
        seen = np.zeros(TERMS)
        for places, _ in made:
            seen[places] += 1
        self.idf = np.log((1 + len(made)) / (1 + seen)) + 1
        used, step = np.flatnonzero(seen), -(-len(made) // FITTED)
        rows = np.zeros((len(made[::step]), TERMS), np.float32)
        for row, (places, weights) in enumerate(made[::step]):
            rows[row, places] = weighted(places, weights, self.idf)
        rows = rows[:, used]
        rng = np.random.default_rng(SEED)
        basis = rows.T @ rng.standard_normal((len(rows), min(DIMENSIONS + 16, len(used))), dtype=np.float32)
        for _ in range(4):  # subspace iteration for the leading singular vectors
            basis, _ = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))
        _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
        self.axes = np.zeros((TERMS, min(DIMENSIONS, right.shape[0])))
        self.axes[used] = basis @ right[: self.axes.shape[1]].T
        self.vectors = self.projected(made)

    def projected(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        v = np.array([weighted(places, weights, self.idf) @ self.axes[places] for places, weights in made]).reshape(len(made), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.zeros(len(texts))
        k = min(NEAREST, len(self.labels))
        for at in range(0, len(texts), ROWS):
            near = np.round(self.projected([terms(t) for t in texts[at : at + ROWS]]) @ self.vectors.T, 9)
            last = np.partition(near, -k, axis=1)[:, -k]
            votes = np.where(near >= last[:, None], np.maximum(near, 1e-3) ** SHARPNESS, 0.0)
            out[at : at + ROWS] = votes @ self.labels / votes.sum(axis=1)
        return np.clip(out, 0, 1)


def _termed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [terms(text) for text in batch["text"]]
        yield pd.DataFrame({"label": batch["label"], "h": batch["h"], "places": [p for p, _ in made], "weights": [w for _, w in made]})


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` different texts of either label (0 or 1)."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(text_col)).alias("h")).where("label in (0, 1)")
    thin = stash(rows.groupBy("label", "h").agg(F.count("*").alias("n")).select("label", "h"), "hashes")
    cuts = {k: thin.where(F.col("label") == k).orderBy("h").limit(sample).agg(F.max("h")).first()[0] for k in (0, 1)}
    chosen = F.lit(False)
    for k, cut in cuts.items():
        if cut is not None:
            chosen = chosen | ((F.col("label") == k) & (F.col("h") <= cut))
    picked = rows.where(chosen).groupBy("label", "h").agg(F.first("text").alias("text"))
    made = picked.mapInPandas(_termed, "label int, h long, places array<int>, weights array<double>").toPandas().sort_values(["label", "h"])
    return Model([(np.array(p, np.int64), np.array(w)) for p, w in zip(made["places"], made["weights"], strict=True)], made["label"].tolist())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: the id, score (0 to 1) and predicted (1 if score >= cut, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "score": shared.value.score(batch["text"].tolist())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scored, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
