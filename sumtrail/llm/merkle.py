"""A Merkle manifest of a dataset: SHA-256 trees over documents, with states kept for folding.

The rows of a group (source), in order of their key, are the leaves of a tree in which every FAN
consecutive nodes become one; the groups' roots are the leaves of the tree above. A digest
in hex fills one block of SHA-256, so a parent's state before each of its children is
eight words. Parents keep these states. To recompute the root for a changed leaf, the
state before its slot is resumed with the new digest and the siblings on its right;
those on its left aren't hashed again.

Trees are built in pieces of FAN * FAN leaves, one row of a table each, as tables that
Spark writes: a group with a third of all rows is many pieces. The pieces' nodes are the
leaves of the next table, until one node a group is left. Paths to the root then go down
the tables, one join each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches, written
from sumtrail.llm.sha import BLOCK, START, U32, compress, finish, words_of

FAN = 16
PIECE = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# What a fold needs of one level above a piece.
STEP = np.dtype([("slot", "<u2"), ("size", "<u2"), ("state", "<u4", 8), ("children", "u1", (FAN, BLOCK))])

_NODE = "g string, chunk bigint, total bigint, keys array<string>, leaves binary, now binary, levels int, states binary, middle binary, middle_states binary, node string"


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Runs:
    """Runs of up to FAN sibling digests, with the state of their parent before each."""

    def __init__(self, children: np.ndarray, sizes: np.ndarray) -> None:
        """``children`` has the hex digests of all runs in order."""
        self.sizes = sizes
        self.children = np.zeros((len(sizes), FAN, BLOCK), dtype=np.uint8)
        self.held = np.arange(FAN) < sizes[:, None]
        self.children[self.held] = children
        self.states = np.empty((0, FAN, 8), dtype=U32)

    def build(self) -> np.ndarray:
        """Keep the states and return the parents' digests."""
        self.states = np.empty((len(self.sizes), FAN, 8), dtype=U32)
        state = np.tile(START, (len(self.sizes), 1))
        for p in range(FAN):
            self.states[:, p] = state
            own = np.flatnonzero(self.sizes > p)
            state[own] = compress(state[own], words_of(self.children[own, p]))
        return finish(state, self.sizes)

    def kept(self) -> np.ndarray:
        return self.states[self.held]

    def resume(self, states: np.ndarray) -> Runs:
        self.states = np.zeros((len(self.sizes), FAN, 8), dtype=U32)
        self.states[self.held] = states
        return self


def fold(states: np.ndarray, slots: np.ndarray, sizes: np.ndarray, children: np.ndarray, which: np.ndarray, replacement: np.ndarray) -> np.ndarray:
    """Parents' digests with the child in ``slots`` replaced.

    ``states`` are those before the slots; only the replacement and what is right of it are hashed.
    ``children[which]`` are each lane's siblings.
    """
    state = states.copy()
    for p in range(FAN):
        own = np.flatnonzero((slots <= p) & (p < sizes))
        if len(own):
            block = children[which[own], p]
            here = slots[own] == p
            block[here] = replacement[own[here]]
            state[own] = compress(state[own], words_of(block))
    return finish(state, sizes)


def _digests(data: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, BLOCK)


def _run_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many runs pieces of ``n`` nodes have, and the size of each run."""
    runs = -(-n // FAN)
    owner = np.repeat(np.arange(len(n)), runs)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return runs, np.minimum(FAN, n[owner] - place * FAN)


def _split(data: np.ndarray, n: np.ndarray) -> list[bytes]:
    ends = np.cumsum(n)
    return [data[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def _pieces(rows: DataFrame) -> DataFrame:
    """Trees of up to two levels over the pieces of each group's nodes.

    ``rows`` have the group ``g``, the number ``r`` of a node in it from 0, ``total``, ``key``,
    ``leaf`` and ``now``, the digest that a fold shall put in the leaf's place.
    """
    chunk = F.floor(F.col("r") / PIECE).cast("bigint").alias("chunk")
    some = rows.groupBy("g", chunk).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("r", "key", "leaf", "now"))).alias("x"))
    joined = lambda c: F.expr(f"cast(array_join(transform(x, y -> y.{c}), '') as binary)").alias(c)
    packed = some.select("g", "chunk", "total", F.expr("transform(x, y -> y.key)").alias("keys"), joined("leaf"), joined("now"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = batch["total"].to_numpy()
            n = batch["leaf"].map(len).to_numpy(dtype=np.int64) // BLOCK
            levels = np.where(total == 1, 0, np.where(total <= FAN, 1, 2)).astype(np.int32)
            runs, sizes = _run_sizes(n)
            low = Runs(_digests(batch["leaf"]), sizes)
            middle = low.build()
            high = Runs(middle, runs)
            nodes = _split(high.build(), np.ones(len(n), np.int64))
            lows, middles = _split(low.kept(), n), _split(middle, runs)
            top = [(leaf, m, h)[k] for leaf, m, h, k in zip(batch["leaf"], middles, nodes, levels, strict=True)]
            yield pd.DataFrame({
                "g": batch["g"], "chunk": batch["chunk"], "total": total, "keys": batch["keys"], "leaves": batch["leaf"], "now": batch["now"], "levels": levels,
                "states": lows, "middle": middles, "middle_states": _split(high.kept(), runs), "node": [t.decode() for t in top],
            })

    return packed.mapInPandas(build, _NODE)


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``r``, the number of a row in its group ``g`` by key and leaf, and the group's ``total``.

    Rows are sorted in ranges, so that a large group lies in many; what is counted for
    each group and range gives the number before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("g", "order", "leaf")
    place = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranges = written(ranges.withColumn("p", F.spark_partition_id()).withColumn("at", place), "ranges")
    counts = ranges.groupBy("g", "p").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    return ranges.join(counts, ["g", "p"]).withColumn("r", F.expr("before + at - first"))


def _trees(rows: DataFrame, name: str) -> list[DataFrame]:
    """Tables of pieces: of ``rows``, of their pieces' nodes, and so on to one node a group."""
    tables = [written(_pieces(rows), name)]
    while (tables[-1].agg(F.max("total")).first()[0] or 0) > PIECE:
        nodes = tables[-1].filter(F.col("total") > PIECE)
        leaf = F.col("node")
        above = nodes.select("g", F.col("chunk").alias("r"), F.ceil(F.col("total") / PIECE).alias("total"), F.lit("").alias("key"), leaf.alias("leaf"), leaf.alias("now"))
        tables.append(written(_pieces(above), name))
    return tables


def _steps(row) -> Iterator[tuple[str, bytes]]:
    """For each leaf of a piece its key, and what a fold needs up to the root."""
    n = len(row.leaves) // BLOCK
    runs, sizes = _run_sizes(np.array([n]))
    low = Runs(_digests([row.leaves]), sizes).resume(np.frombuffer(row.states, "<u4").reshape(-1, 8))
    high = Runs(_digests([row.middle]), runs).resume(np.frombuffer(row.middle_states, "<u4").reshape(-1, 8))
    for k in range(n):
        own = np.zeros(row.levels, dtype=STEP)
        for level, (tree, run, slot) in enumerate(((low, k // FAN, k % FAN), (high, 0, k // FAN))[: row.levels]):
            own[level] = slot, tree.sizes[run], tree.states[run, slot], tree.children[run]
        yield row.keys[k], own.tobytes() + row.path


def _paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first table with ``path``: what a fold needs above each piece.

    ``above`` has the ``path`` of each group's root.
    """

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                paths = [p for _, p in _steps(row)]
                yield pd.DataFrame({"g": row.g, "chunk": row.chunk * PIECE + np.arange(len(paths)), "path": paths})

    below = None
    for table in reversed(tables):
        found = table.filter(F.col("total") <= PIECE).join(above, "g")
        if below is not None:
            found = found.unionByName(table.filter(F.col("total") > PIECE).join(below, ["g", "chunk"]))
        below = found.mapInPandas(down, "g string, chunk bigint, path binary")
    return found


def _siblings(children: bytes, slot: int) -> bytes:
    return children[: slot * BLOCK] + children[(slot + 1) * BLOCK :]


def _folded(batch: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """The recomputed root and the digest of all siblings, for each leaf of some pieces."""
    n = batch["leaves"].map(len).to_numpy(dtype=np.int64) // BLOCK
    levels = batch["levels"].to_numpy()
    runs, sizes = _run_sizes(n)
    first_run = np.cumsum(runs) - runs
    low = Runs(_digests(batch["leaves"]), sizes).resume(np.frombuffer(b"".join(batch["states"]), "<u4").reshape(-1, 8))
    high = Runs(_digests(batch["middle"]), runs).resume(np.frombuffer(b"".join(batch["middle_states"]), "<u4").reshape(-1, 8))
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    run, slot = first_run[piece] + place // FAN, place % FAN
    now = _digests(batch["now"]).copy()

    own = np.flatnonzero(levels[piece] >= 1)
    now[own] = fold(low.states[run[own], slot[own]], slot[own], low.sizes[run[own]], low.children, run[own], now[own])
    own = np.flatnonzero(levels[piece] == 2)
    _fold_distinct(now, own, piece[own], place[own] // FAN, high.states, high.sizes, high.children)
    steps = [np.frombuffer(p, STEP) for p in batch["path"]]
    depth = np.array([len(s) for s in steps])
    for k in range(depth.max(initial=0)):
        deep = np.flatnonzero(depth > k)
        number = np.full(len(n), -1)
        number[deep] = np.arange(len(deep))
        here = np.array([steps[d][k] for d in deep], dtype=STEP)
        states = np.zeros((len(deep), FAN, 8), dtype=U32)
        states[np.arange(len(deep)), here["slot"]] = here["state"]
        own = np.flatnonzero(number[piece] >= 0)
        at = number[piece[own]]
        _fold_distinct(now, own, at, here["slot"][at].astype(np.int64), states, here["size"].astype(np.int64), here["children"])

    proofs = []
    for d, row in enumerate(batch.itertuples()):
        above = b"".join(_siblings(s["children"][: s["size"]].tobytes(), int(s["slot"])) for s in steps[d])
        for k in range(int(n[d])):
            r = k // FAN
            found = hashlib.sha256()
            if row.levels:
                found.update(_siblings(row.leaves[r * FAN * BLOCK : (r + 1) * FAN * BLOCK], k % FAN))
            if row.levels == 2:
                found.update(_siblings(row.middle, r))
            found.update(above)
            proofs.append(found.hexdigest())
    return now, proofs


def _fold_distinct(now: np.ndarray, own: np.ndarray, which: np.ndarray, slot: np.ndarray, states: np.ndarray, sizes: np.ndarray, children: np.ndarray) -> None:
    """Fold the lanes ``own`` of ``now``; equal digests in one slot are folded once."""
    if not len(own):
        return
    key = np.empty(len(own), dtype=[("w", "<i8"), ("s", "<i8"), ("d", f"S{BLOCK}")])
    key["w"], key["s"], key["d"] = which, slot, now[own].view(f"S{BLOCK}").ravel()
    _, at, back = np.unique(key.view(f"V{key.dtype.itemsize}"), return_index=True, return_inverse=True)
    w, s = which[at], slot[at]
    now[own] = fold(states[w, s], s, sizes[w], children, w, now[own[at]])[back]


class Manifest:
    """Tables of a dataset's trees: ``documents`` by group, ``groups`` above them."""

    def __init__(self, documents: list[DataFrame], groups: list[DataFrame], root: str | None) -> None:
        self.documents, self.groups, self.root = documents, groups, root

    def subroots(self) -> DataFrame:
        return _tops(self.documents)


def _tops(tables: list[DataFrame]) -> DataFrame:
    parts = [t.filter(F.col("total") <= PIECE).select("g", F.col("node").alias("subroot")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def build_manifest(rows: DataFrame) -> Manifest:
    """The trees of ``rows`` with ``key``, ``group``, ``leaf`` (hex digest) and ``now``.

    A group's leaves are in order of ``key``, null first, then of their digests. Groups are in the order of
    their UTF-8 bytes, null first. Rows that repeat a key are a leaf each.
    """
    # A null group comes before all others, the empty one too.
    g = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    leaves = rows.select(g.alias("g"), F.col("key").alias("order"), F.col("key").cast("string").alias("key"), "leaf", F.coalesce("now", "leaf").alias("now"))
    documents = _trees(_ranked(written(leaves, "leaves")), "documents")
    tops = _tops(documents).select(F.lit("").alias("g"), F.col("g").alias("order"), F.col("g").alias("key"), F.col("subroot").alias("leaf"), F.col("subroot").alias("now"))
    groups = _trees(_ranked(tops), "groups")
    top = _tops(groups).first()
    return Manifest(documents, groups, top["subroot"] if top else None)


def fold_manifest(manifest: Manifest, spark) -> DataFrame:
    """For each leaf ``key``, ``leaf``, ``subroot``, ``proof_sha256`` and ``folded_root``.

    The folded root is recomputed from ``now``, the kept states and the siblings on the right; equal
    to the manifest's if the leaf is unchanged. The proof is the digest of all siblings up to the root.
    """
    whole = spark.createDataFrame([("", b"")], "g string, path binary")

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(list(_steps(row)), columns=["g", "path"])

    above = _paths(manifest.groups, whole).mapInPandas(up, "g string, path binary")
    pieces = _paths(manifest.documents, written(above, "paths")).join(manifest.subroots(), "g")

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            now, proofs = _folded(batch)
            n = batch["leaves"].map(len).to_numpy(dtype=np.int64) // BLOCK
            hexes = lambda x: np.ascontiguousarray(x).view(f"S{BLOCK}").ravel().astype(str)
            yield pd.DataFrame({
                "key": [k for keys in batch["keys"] for k in keys], "leaf": hexes(_digests(batch["leaves"])), "subroot": np.repeat(batch["subroot"].to_numpy(), n),
                "proof_sha256": proofs, "folded_root": hexes(now),
            })

    few = pieces.select("keys", "leaves", "now", "levels", "states", "middle", "middle_states", "path", "subroot")
    return few.mapInPandas(folds, "key string, leaf string, subroot string, proof_sha256 string, folded_root string")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and folded root of every document; in a fifth of them the text is changed.

    Null values count as null in the leaf; rows with a null id come first in their source and are not
    changed. Repeated rows are a leaf each. An empty table gives an empty result.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fields = {f: F.col(f) for f in FIELDS}
    changed = fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("source").alias("group"), digest([*fields.values()]).alias("leaf"),
        F.when(tampered, digest([*changed.values()])).alias("now"),
    )
    manifest = build_manifest(rows)
    found = fold_manifest(manifest, spark)
    root = F.lit(manifest.root).cast("string")
    return found.select(
        F.col("key").cast("bigint").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
