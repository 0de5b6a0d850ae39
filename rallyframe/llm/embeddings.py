"""Embedding near-dedup: Euclidean p-stable hashing with exact cosine checks.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2 t). Each of ``TABLES`` tables hashes a vector by
``PROJECTIONS`` normal projections, shifted and cut into steps of ``STEP``. For pairs just at cosine 0.95 a projection
agrees with probability 0.87, a bucket with 0.19 and one of 40 tables with over 0.999; unrelated vectors share a bucket with
probability 0.0002.

Equal vectors are collapsed into a class first. Buckets with one class drop out. What meets in a bucket first is a sketch
of 128 sign bits: only classes with a sketch near another's (six standard deviations beyond the angle asked for) send
their vectors there, which are compared by exact cosine in double precision. A bucket of more than ``BLOCK`` classes is
compared block against block, so none is capped and none meets in one task; a block returns the number of links of each
vector and one connecting pair for each vector of a component, not the links. A pair counts in the first table in which it
shares a bucket.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths never link; classes have numbers of their own, so rows that repeat an id are vectors of their own with the
same id, and rows without an id count as partners and get kept false (a component is named by its smallest id that is not
null); an empty table gives an empty table; input columns other than id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.components import components
from rallyframe.llm.runs import runs
from rallyframe.plans.scratch import stash, unstash

TABLES, PROJECTIONS, STEP, BLOCK, SEED = 40, 12, 2.0, 1024, 3
#: Sign bits of a sketch; classes of a bucket that are compared together with other buckets.
BITS, SMALL = 128, 64


@lru_cache(maxsize=8)
def _parts(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((width, TABLES * PROJECTIONS)), rng.uniform(0, STEP, TABLES * PROJECTIONS), rng.integers(1, 2**63, PROJECTIONS, dtype=np.uint64) | np.uint64(1)


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keys(v: np.ndarray) -> np.ndarray:
    """The TABLES bucket keys of unit vectors."""
    project, shift, odd = _parts(v.shape[1])
    cells = np.floor((v @ project + shift) / STEP).astype(np.int64).astype(np.uint64).reshape(len(v), TABLES, PROJECTIONS)
    keys = np.full((len(v), TABLES), v.shape[1], np.uint64)
    for p in range(PROJECTIONS):
        keys = (keys ^ (cells[:, :, p] + np.uint64(0x9E37))) * odd[p]
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def _sketches(v: np.ndarray) -> np.ndarray:
    """Two words of sign bits for each vector."""
    signs = v @ np.random.default_rng(SEED + 1).standard_normal((v.shape[1], BITS)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def _apart(least: float) -> int:
    """Sign bits in which two vectors of this cosine may differ, six standard deviations included."""
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    return int(np.ceil(BITS * p + 6 * np.sqrt(BITS * p * (1 - p))))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, rows in batch.groupby(batch["embedding"].map(len), sort=False):
            v = _unit(rows["embedding"].tolist())
            sketch = _sketches(v).astype(np.int64)
            yield pd.DataFrame({"c": rows["c"].to_numpy(), "keys": list(_keys(v)), "s": sketch[:, 0], "t": sketch[:, 1]})


def _near(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The row numbers that occur in a pair of (a, b) with near sketches."""
    s, t = rows["s"].to_numpy().astype(np.uint64), rows["t"].to_numpy().astype(np.uint64)
    some = np.bitwise_count(s[a] ^ s[b]).astype(np.int64) + np.bitwise_count(t[a] ^ t[b]) <= most
    return np.unique(np.concatenate((a[some], b[some])))


def _met(rows: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Of small buckets (runs of equal nodes) the rows with a near sketch beside them, buckets of one size together."""
    node = rows["node"].to_numpy()
    start = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
    size = np.diff(np.concatenate((start, [len(rows)])))
    for n in np.unique(size[size > 1]):
        i, j = np.triu_indices(n, 1)
        own = start[size == n]
        step = max(1, 262_144 // len(i))
        for at in range(0, len(own), step):
            found = _near(rows, (own[at : at + step, None] + i).ravel(), (own[at : at + step, None] + j).ravel(), most)
            if len(found):
                yield rows.iloc[found][["node", "table", "c", "side"]]


def _sifted(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows (node, table, c, side, s, t) that have a near sketch in their node. The partition is sorted by node."""
    held: list[pd.DataFrame] = []
    count = 0
    for rows in runs(batches, "node"):
        side = rows["side"].to_numpy()
        if len(rows) > SMALL or side[0] != 2:
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            found = [_near(rows, np.full(len(other), i), other, most) for i in left if len(other := right[(right > i) if side[i] == 2 else (side[right] != side[i])])]
            if found and len(at := np.unique(np.concatenate(found))):
                yield rows.iloc[at][["node", "table", "c", "side"]]
            continue
        held.append(rows)
        count += len(rows)
        if count >= 16_384:
            yield from _met(pd.concat(held, ignore_index=True), most)
            held, count = [], 0
    if held:
        yield from _met(pd.concat(held, ignore_index=True), most)


def _rooted(linked: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The least place that each place reaches. linked: a symmetric matrix."""
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _block(rows: pd.DataFrame, least: float) -> pd.DataFrame | None:
    """Links among the rows of one block (side 2) or between side 0 and side 1: counts (a, null, n) and connecting pairs (a, b, 0)."""
    v = _unit(rows["embedding"].tolist())
    ids, copies, sides, table = rows["c"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy(), int(rows["table"].iloc[0])
    near = v @ v.T >= least - 1e-9
    near &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
    i, j = np.nonzero(np.triu(near, 1))
    exact = np.concatenate([np.einsum("ij,ij->i", v[i[at : at + 65536]], v[j[at : at + 65536]]) >= least for at in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[exact], j[exact]
    if not len(i):
        return None
    linked = np.zeros(near.shape, bool)
    linked[i, j] = linked[j, i] = True
    keys = np.array(rows["keys"].tolist(), np.int64)
    first = np.ones(len(i), bool)
    for t in range(table):  # a pair that shares an earlier table's bucket is counted there
        first &= keys[i, t] != keys[j, t]
    i, j = i[first], j[first]
    count = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    some = np.flatnonzero(count)
    root = _rooted(linked, np.arange(len(rows)))
    moved = np.flatnonzero(root != np.arange(len(rows)))
    return pd.DataFrame({
        "a": np.concatenate((ids[some], ids[moved])),
        "b": pd.array([None] * len(some) + ids[root[moved]].tolist(), "Int64"),
        "n": np.concatenate((count[some], np.zeros(len(moved)))).astype(np.int64),
    })


def _compared(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for rows in runs(batches, "node"):
        if (found := _block(rows, least)) is not None:
            yield found


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: the id, n_links (other vectors linked directly), component_id and kept (id = component_id)."""
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = source.where(fine)
    # a third of the vectors may be equal: the aggregate combines them before its shuffle
    grouped = valid.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = stash(grouped.withColumn("c", F.monotonically_increasing_id()), "vectors")
    hashed = stash(classes.select("c", "embedding").mapInPandas(_hashed, "c long, keys array<long>, s long, t long"), "hashed")
    spread = hashed.select("c", "s", "t", F.posexplode("keys").alias("table", "key"))
    size = stash(spread.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    found = spread.join(size, ["table", "key"]).withColumn("of", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("c"), F.col("of")).cast("int"))
    met = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    met = met.select("c", "s", "t", "table", F.xxhash64("table", "key", low, high).alias("node"), side.alias("side"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "node").sortWithinPartitions("node", "c")
    most = _apart(least)
    near = stash(met.mapInPandas(lambda it: _sifted(it, most), "node long, table int, c long, side int"), "near")
    full = near.join(classes.select("c", "embedding", "copies"), "c").join(hashed.select("c", "keys"), "c").repartition(parts, "node").sortWithinPartitions("node", "c")
    pairs = stash(full.mapInPandas(lambda it: _compared(it, least), "a long, b long, n long"), "linked")
    unstash(size, near)
    label = components(pairs.where("b is not null").select("a", "b")).withColumnRenamed("id", "c")
    counts = pairs.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    labelled = stash(classes.select("c", "id", "copies").join(counts, "c", "left").join(label, "c", "left").withColumn("component", F.coalesce("component", "c")), "labelled")
    least_id = labelled.groupBy("component").agg(F.min("id").alias("least"))
    known = labelled.join(least_id, "component").join(classes.select("c", "embedding"), "c").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    linked = valid.join(known, "embedding").select("id", "n_links", F.col("least").alias("component"))
    alone = source.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
