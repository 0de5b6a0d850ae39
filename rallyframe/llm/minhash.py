"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets form one class, so copies, however many, are compared once. Each class has a MinHash
signature. A tree's root holds all classes; a node chooses each of the first ``PLACES`` signature places with probability
1 / (threshold * places), the same for all its classes, and a class moves to the child named by its value there:
1 / threshold children on average. Pairs at the threshold stay together with one child expected a level. Nodes of at most
``small`` classes are compared exhaustively; larger ones branch again, and those still large after ``DEPTH`` levels are
compared in blocks of ``block`` classes, each pair of blocks once for all nodes and trees, so nothing is capped. So are, at
any level, crowds: nodes of at most ``TREES`` blocks of which one child holds more than half, as branching hardly parts
their classes and would send each on in every tree and level. ``TREES`` independent trees give the recall (over 0.997 at
the threshold for nodes that branch up to three times, far higher for nodes that need not).

Dense groups never emit their pairs. The first trees compare each node's classes with one pivot; what these links connect
is one component and is not compared again, and nodes that hold one component drop out. In the other nodes signatures
are compared first, and only classes that have a likely partner of another component go on, in the first tree only where
the two meet. Their whole shingle sets then meet once more by node: every pair of different components is compared
exactly, and each node returns the links that connect its components, not all pairs.

Defined cases: null and blank texts have an empty set, link with nothing and form their own component; classes are keyed
by the digest of their set, so rows that share an id, or have none, are compared as the texts they hold; rows that repeat
an id each get a row; rows without an id count as texts, but a component is named by its smallest id that is not null, and
kept is false for them; an empty table gives an empty table; input columns other than id and text are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.components import components
from rallyframe.llm.runs import runs
from rallyframe.llm.shingles import digest, factors, mixed, shingle_set, signature
from rallyframe.plans.scratch import sized_join, stash, unstash

#: Signature places with 32 bits, by which nodes branch, and places of which one byte is kept for comparing.
PLACES, BYTES = 64, 192
TREES = 16
#: Trees whose nodes are compared with a pivot first; two in a row choose pivots in the same order.
STARS = 4
SMALL = 64
BLOCK = 256
DEPTH = 3
#: Standard deviations that a signature's estimate may fall short of the threshold.
SLACK = 4.0
SEED = 5


def _least(threshold: float, places: int, slack: float = SLACK) -> int:
    """Places that must agree, of so many, for a pair to be compared exactly."""
    return int(np.floor(places * threshold - slack * np.sqrt(places * threshold * (1 - threshold))))


def _documents(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """id, hash, n_shingles, key (digest of the set; null if empty) and signature of each text."""
    own = factors(PLACES + BYTES, SEED)
    for batch in batches:
        rows = []
        for at, code, text in zip(batch["id"], batch["hash"], batch["text"], strict=True):
            found = shingle_set(text, width)
            if not len(found):
                rows.append((at, code, 0, None, None))
                continue
            values = signature(found, own)
            rows.append((at, code, len(found), digest(found), values[:PLACES].tobytes() + values[PLACES:].astype(np.uint8).tobytes()))
        yield pd.DataFrame(rows, columns=["id", "hash", "n", "key", "sig"]).astype({"id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"c": batch["c"], "shingles": [shingle_set(text, width).tobytes() for text in batch["text"]]})


def _signatures(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The branching places and the bytes of each signature."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 4 * PLACES + BYTES)
    return np.ascontiguousarray(raw[:, : 4 * PLACES]).view(np.uint32), np.ascontiguousarray(raw[:, 4 * PLACES :])


def _draws(nodes: np.ndarray) -> np.ndarray:
    """A random number for each node and place."""
    places = np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(nodes[:, None] ^ places[None, :])


def _cut(threshold: float) -> np.uint64:
    return np.uint64(int(2**64 / (threshold * PLACES)))


def _roots() -> np.ndarray:
    return mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=8)
def _chosen(threshold: float) -> np.ndarray:
    """Which places the root of each tree chooses."""
    return _draws(_roots()) < _cut(threshold)


def _branch(nodes: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row in turn its children: (row numbers, child nodes)."""
    draw = _draws(nodes)
    row, place = np.nonzero(draw < _cut(threshold))
    return row, mixed(draw[row, place] + sigs[row, place].astype(np.uint64))


def _first(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            sigs, ids = _signatures(batch["sig"])[0], batch["c"].to_numpy(np.int64)
            for tree, root in enumerate(_roots()):
                row, node = _branch(np.full(len(batch), root), sigs, threshold)
                yield pd.DataFrame({"tree": np.full(len(row), tree, np.int32), "node": node.astype(np.int64), "c": ids[row]})


def _next(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            row, node = _branch(batch["node"].to_numpy(np.int64).astype(np.uint64), _signatures(batch["sig"])[0], threshold)
            yield pd.DataFrame({"tree": batch["tree"].to_numpy()[row], "node": node.astype(np.int64), "c": batch["c"].to_numpy()[row], "parent": batch["node"].to_numpy()[row], "held": batch["size"].to_numpy()[row]})


def _crowds(children: DataFrame, most: int) -> DataFrame:
    """The nodes (parent) of at most so many classes of which one child holds more than half. children: node, parent, held (the parent's size)."""
    sizes = children.where(F.col("held") <= most).groupBy("parent", "node", "held").agg(F.count("*").alias("n"))
    return sizes.where("2 * n > held").select("parent").distinct()


def _likely(left: tuple, right: tuple, threshold: float) -> np.ndarray:
    """Which rows of two aligned signature lists agree enough to be compared exactly."""
    out = np.count_nonzero(left[0] == right[0], axis=1)
    some = np.flatnonzero(out >= _least(threshold, PLACES, SLACK + 1))
    both = out[some] + np.count_nonzero(left[1][some] == right[1][some], axis=1)
    found = np.zeros(len(out), bool)
    found[some] = both >= _least(threshold, PLACES + BYTES)
    return found


def _near(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield batch.loc[_likely(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), threshold), ["a", "b"]]


class _Unit:
    """Rows of one or more nodes (unit, c, label, sig, side, tree, deep, wide): who has a likely partner met here first?"""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.rows, self.threshold = rows, threshold
        self.values, self.bytes = _signatures(rows["sig"])
        self.labels, self.side = rows["label"].to_numpy(), rows["side"].to_numpy()
        self.tree, self.deep, self.wide = rows["tree"].to_numpy(), rows["deep"].to_numpy(bool), rows["wide"].to_numpy(np.int64)

    def flagged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The row numbers that occur in a likely pair of (a, b), but for pairs that another tree's small node compares."""
        fits = _likely((self.values[a], self.bytes[a]), (self.values[b], self.bytes[b]), self.threshold)
        a, b = a[fits], b[fits]
        if len(a):
            met = (self.values[a] == self.values[b]).astype(np.float32) @ _chosen(self.threshold).T.astype(np.float32) > 0
            trees = np.arange(TREES)
            met &= (self.wide[a][:, None] >> trees) & 1 == 0
            met &= self.deep[a][:, None] | (trees < self.tree[a][:, None])
            new = ~met.any(axis=1)
            a, b = a[new], b[new]
        return np.unique(np.concatenate((a, b)))

    def told(self, at: np.ndarray) -> pd.DataFrame:
        return self.rows.iloc[at][["unit", "c", "label", "side"]]


def _partners(batches: Iterator[pd.DataFrame], threshold: float, small: int) -> Iterator[pd.DataFrame]:
    """The rows with likely partners, unit by unit in a partition sorted by unit; small nodes together with those of their size."""
    held: list[pd.DataFrame] = []
    count = 0
    for rows in runs(batches, "unit"):
        if len(rows) > small or rows["side"].iloc[0] != 2:
            yield from _block(rows, threshold)
            continue
        held.append(rows)
        count += len(rows)
        if count >= 4096:
            yield from _together(pd.concat(held, ignore_index=True), threshold)
            held, count = [], 0
    if held:
        yield from _together(pd.concat(held, ignore_index=True), threshold)


def _block(rows: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    unit, found = _Unit(rows, threshold), []
    left, right = np.flatnonzero(unit.side != 1), np.flatnonzero(unit.side != 0)
    for i in left:
        other = right[(unit.labels[right] != unit.labels[i]) & ((unit.side[right] != unit.side[i]) | (right > i))]
        if len(other):
            found.append(unit.flagged(np.full(len(other), i), other))
    if found and len(at := np.unique(np.concatenate(found))):
        yield unit.told(at)


def _together(rows: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    unit, own = _Unit(rows, threshold), rows["unit"].to_numpy()
    start = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
    size = np.diff(np.concatenate((start, [len(rows)])))
    found = []
    for n in np.unique(size):
        i, j = np.triu_indices(n, 1)
        first = start[size == n]
        step = max(1, 16384 // max(1, len(i)))
        for at in range(0, len(first), step):
            a, b = (first[at : at + step, None] + i).ravel(), (first[at : at + step, None] + j).ravel()
            apart = unit.labels[a] != unit.labels[b]
            found.append(unit.flagged(a[apart], b[apart]))
    if found and len(at := np.unique(np.concatenate(found))):
        yield unit.told(at)


def _linked(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """The links (a, b) that connect each unit's components, confirmed on whole sets. Rows: unit, c, label, side, shingles, sorted by unit."""
    percent = round(100 * threshold)
    for rows in runs(batches, "unit"):
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        ids, side = rows["c"].to_numpy(), rows["side"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
        _, root = np.unique(rows["label"].to_numpy(), return_inverse=True)
        mark, out = np.zeros(int(codes.max()) + 1, bool), []
        for i in np.flatnonzero(side != 1):
            able = (root != root[i]) & (side != 0 if side[i] == 0 else side == 2) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            if not able.any():
                continue
            mark[codes[ends[i] - sizes[i] : ends[i]]] = True
            both = np.bincount(owner[mark[codes]], minlength=len(sets))
            mark[:] = False
            for j in np.flatnonzero(able & (100 * both >= percent * (sizes + sizes[i] - both))):
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((ids[i], ids[j]))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def _blocks(large: DataFrame, sig: DataFrame, block: int) -> DataFrame:
    """Large nodes (node, size, c, label, wide, ...) as pairs of blocks: unit and side.

    A class has one block, whatever nodes and trees hold it. Its home is the largest node that holds it; the homes of alike
    nodes are one group, that of the home of most of their classes, and a group's classes are dealt to blocks together, so
    that blocks are full and few. Two blocks meet once if any node holds classes of both. A group's most frequent component
    has blocks of its own, which do not meet each other; so the work grows with the rows of the other components.
    """
    rows = large.select("node", "c", "label", "wide", F.max(F.struct("size", "node")).over(Window.partitionBy("c"))["node"].alias("home"))
    shares = rows.groupBy("node", "home").agg(F.count("*").alias("n"))
    groups = shares.groupBy(F.col("node").alias("home")).agg(F.max_by("home", F.struct("n", "home")).alias("group"))
    rows = rows.join(stash(groups, "groups"), "home")
    per = rows.where("node = home").groupBy("group", "label").agg(F.count("*").alias("n"))
    lead = per.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("lead"), F.max("n").alias("most"), F.sum("n").alias("all"))
    rows = rows.join(stash(lead, "lead"), "group").withColumn("own", F.col("label") == F.col("lead"))
    parts = F.ceil(F.when(F.col("own"), F.col("most")).otherwise(F.col("all") - F.col("most")) / block)
    rows = rows.withColumn("at", F.xxhash64("group", "own", F.pmod(F.xxhash64("c"), parts).cast("int")))
    held = stash(rows.select("node", "at", F.when(F.col("own"), F.col("lead")).alias("sole")).distinct(), "blocks")
    x, y = held.withColumnsRenamed({"at": "x", "sole": "sole_x"}), held.withColumnsRenamed({"at": "y", "sole": "sole_y"})
    met = x.join(y, "node").where("x <= y and not coalesce(sole_x = sole_y, false)").select("x", "y").distinct()
    side = lambda at, n: F.struct(F.col(at).alias("at"), F.lit(n).alias("side"))
    sides = met.select(F.xxhash64("x", "y").alias("unit"), F.explode(F.when(F.col("x") == F.col("y"), F.array(side("x", 2))).otherwise(F.array(side("x", 0), side("y", 1)))).alias("m")).select("unit", "m.*")
    members = rows.where("node = home").select("c", "label", "wide", "at").join(sig, "c")
    return members.join(stash(sides, "sides"), "at").select("unit", "c", "label", "sig", "side", F.lit(0).alias("tree"), "wide")


def _kept_nodes(named: DataFrame, small: int) -> DataFrame:
    """The nodes (node, size) that hold two components; of small ones with the same classes, which compare the same pairs, the first tree's."""
    nodes = named.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("c")).alias("held"), F.min("tree").alias("tree"))
    alike = nodes.where("low < high").groupBy("size", "low", "high", "held", F.when(F.col("size") > small, F.col("node")).alias("large"))
    return alike.agg(F.min(F.struct("tree", "node")).alias("first")).select("first.node", "size")


def _labelled(docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, hash, n, key) and the component of each key (key, component: a number)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    shingled = stash(texts.mapInPandas(lambda it: _documents(it, width), "id long, hash long, n long, key binary, sig binary"), "shingled")
    signed = shingled.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "hash")).alias("at"), F.first("sig").alias("sig"))
    signed = stash(signed.withColumn("c", F.monotonically_increasing_id()), "signed")
    # signatures, most of the bytes, lie in tables of their own that go when the nodes have them
    base = stash(shingled.drop("sig"), "rows")
    unstash(shingled)
    classes, sig = stash(signed.drop("sig"), "classes"), signed.select("c", "sig")
    every = stash(sig.mapInPandas(lambda it: _first(it, threshold), "tree int, node long, c long"), "nodes")
    shared = stash(every.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "shared")
    nodes = stash(sized_join(every, shared, ["node"], "left_semi", shared.count()), "nodes")
    unstash(every, shared)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(units: DataFrame) -> DataFrame:
        """The links of units (unit, c, label, side), by their classes' whole sets."""
        # null ids are matched by a number besides
        known = lambda df: df.withColumns({"__none": F.col("id").isNull(), "__id": F.coalesce("id", F.lit(0))})
        place = ["__none", "__id", "hash"]
        needed = stash(known(units.select("c").distinct().join(classes.select("c", "at.id", "at.hash"), "c")).select(*place, "c"), "needed")
        n = needed.count()
        sets = stash(sized_join(known(texts), needed, place, "inner", n).select("c", "text").mapInPandas(lambda it: _sets(it, width), "c long, shingles binary"), "sets")
        if sets.count() > n:  # rows that repeat both id and text
            sets = stash(sets.dropDuplicates(["c"]), "sets")
        full = units.join(sets, "c").repartition(spread, "unit").sortWithinPartitions("unit", "c")
        found = stash(full.mapInPandas(lambda it: _linked(it, threshold), "a long, b long"), "confirmed")
        unstash(needed, sets)
        return found

    # pivots: in each node of the first trees, all classes against one
    first = nodes.where(F.col("tree") < STARS)
    rank = F.xxhash64(F.floor(F.col("tree") / 2), "c")
    pivot = stash(first.groupBy("node").agg(F.min_by("c", rank).alias("a")), "pivots")
    pairs = first.join(pivot, "node").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("c").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("c").alias("b"), F.col("sig").alias("sig_b")), "b")
    star = stash(pairs.mapInPandas(lambda it: _near(it, threshold), "a long, b long"), "stars")
    # a pivot meets its classes in parts
    part = F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("n") / block), F.lit(1)))
    parted = star.join(stash(star.groupBy("a").agg(F.count("*").alias("n")), "sizes"), "a").select("a", "b", F.xxhash64("a", part).alias("unit"))
    units = parted.select("unit", F.col("b").alias("c"), F.col("b").alias("label"), F.lit(1).alias("side")).union(parted.select("unit", F.col("a").alias("c"), F.col("a").alias("label"), F.lit(0).alias("side")).distinct())
    links = linked(stash(units, "units"))
    label = stash(components(links).select(F.col("id").alias("c"), F.col("component").alias("label")), "labels")

    # what pivots left apart: all nodes that still hold two components
    levels, whole, done = [], [], []
    for depth in range(DEPTH + 1):
        named = nodes.join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
        size = stash(_kept_nodes(named, small), "sizes")
        named = named.join(size, "node")
        if not depth:  # the trees in which a class is in a node too large to be compared at the first level
            named = stash(named, "named")
            wide = stash(named.where(F.col("size") > small).groupBy("c").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("wide")), "wide")
            done += [named, wide]
        held = stash(named.join(wide, "c", "left").withColumn("wide", F.coalesce("wide", F.lit(0))).join(deeper if depth else sig, "c"), "mixed")
        if not depth:
            deeper = stash(held.where(F.col("size") > small).groupBy("c").agg(F.first("sig").alias("sig")), "deeper")
            unstash(signed)
            done.append(deeper)
        done += [size, held]
        levels.append(held.where(F.col("size") <= small).select(F.xxhash64(F.lit(depth), "node").alias("unit"), "c", "label", "sig", F.lit(2).alias("side"), "tree", F.lit(depth > 0).alias("deep"), "wide"))
        large = held.where(F.col("size") > small)
        if large.isEmpty():
            break
        rows = large.select("node", "size", "c", "label", "wide")
        if depth == DEPTH:  # exact way for the rest
            whole.append(rows)
            break
        nodes = stash(large.mapInPandas(lambda it: _next(it, threshold), "tree int, node long, c long, parent long, held long"), "nodes")
        crowds = stash(_crowds(nodes, TREES * block), "crowds")
        done += [nodes, crowds]
        if not crowds.isEmpty():
            whole.append(stash(rows.join(crowds, F.col("node") == F.col("parent"), "left_semi"), "crowded"))
            done.append(whole[-1])
            nodes = nodes.join(crowds, "parent", "left_anti")
        nodes = nodes.select("tree", "node", "c")
    if whole:
        levels.append(_blocks(reduce(DataFrame.unionByName, whole), deeper, block).withColumn("deep", F.lit(True)))
    met = reduce(DataFrame.unionByName, levels).repartition(spread, "unit").sortWithinPartitions("unit", "c")
    likely = stash(met.mapInPandas(lambda it: _partners(it, threshold, small), "unit long, c long, label long, side int"), "likely")
    whole = components(links.union(linked(likely)))
    out = classes.select("key", "c").join(whole.withColumnRenamed("id", "c"), "c", "left").select("key", F.coalesce("component", "c").alias("component"))
    out = stash(out, "components")
    unstash(*done)
    return base, out


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: the id, n_shingles, component_id (smallest id reachable by links) and kept (id = component_id).

    small, block: the classes of a node compared at once, and those of a block.
    """
    base, known = _labelled(docs, width, threshold, id_col, text_col, small, block)
    keyed = base.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    least = keyed.join(known, "key").groupBy("component").agg(F.min("id").alias("least"))
    named = stash(known.join(least, "component").select("key", "least"), "names")
    out = base.select("id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (rows without one last), then of the least hash of the text.

    Rows that repeat both id and text count as one, of which the first by all other columns stays; empty texts all stay.
    """
    base, known = _labelled(docs, width, threshold, id_col, text_col, SMALL, BLOCK)
    rows = base.where("key is not null").select("key", F.col("id").isNull().alias("__none"), F.coalesce("id", F.lit(0)).alias("__id"), F.col("hash").alias("__hash"))
    rows = rows.groupBy("key", "__none", "__id", "__hash").agg(F.count("*").alias("n")).join(known, "key")
    place = ["__none", "__id", "__hash"]
    stays = stash(rows.groupBy("component").agg(F.min(F.struct(*place)).alias("w")), "stays")
    kinds = stash(rows.join(stays, "component").withColumn("gone", F.struct(*place) != F.col("w")).where("gone or n > 1").select(*place, "gone"), "gone")
    n = kinds.count()
    named = docs.withColumns({"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__hash": F.xxhash64(F.col(text_col))})
    marked = sized_join(named, kinds, place, "left", n).where("not coalesce(gone, false)")
    once = marked.where("gone is null").select(*docs.columns)
    if kinds.where("not gone").isEmpty():
        return once
    fixed = [F.to_json(F.struct(*docs.columns))]
    again = marked.where("not gone").withColumn("__n", F.row_number().over(Window.partitionBy(*place).orderBy(*fixed))).where("__n = 1")
    return once.unionByName(again.select(*docs.columns))
