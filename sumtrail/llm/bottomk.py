"""Near duplicates by bottom-k sketches from one hash function.

The sketch of a set is its KEEP smallest hashes. Inverted lists of the retained values
give the pairs of sketches that overlap. The sketch of the union of two sets is the KEEP
smallest of both sketches, and the share of it that both hold estimates their
similarity; pairs below what a true link can have are dropped, and the others are
confirmed on the full sets.

Of KEEP values of the union so many are common in a link, but for one link in 10^9, as
``least_matches`` tells for the set's size (and for sets that fit into their sketch always).
So a sketch need only be listed under its rarest values: two sketches that have ``need``
values in common share one of the first ``size - need + 1`` of each in the order of rarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.llm.components import connected_components
from sumtrail.llm.folders import small_batches, written
from sumtrail.llm.jaccard import BROADCAST_IDS, SALTS, shingle_sets
from sumtrail.llm.text import U64, chunks, mix

WORDS = 3
PERCENT = 85
KEEP = 128
# A link at the least similarity is missed with less than this probability.
MISS = 1e-9
# Bits by which sets are compared before their sketches are: so many longs of 64.
LONGS = 8
# Members of an inverted list that all others are compared with first.
PIVOTS = 8
# Sets of more elements need as many matches as if their number had no bound.
LARGE = 1 << 13

_SIGNATURE = ("n", "sig_a", "sig_b")
_BITS = [f"b{k}" for k in range(LONGS)]
_PAIR = ["x.c AS c", "y.c AS d", "x.node AS a", "y.node AS b"]


def least_matches(percent: int, keep: int, miss: float = MISS) -> np.ndarray:
    """For sets of 0, 1, 2 ... elements the values that two sketches must have in common.

    The matches of a link are those that ``keep`` draws without replacement from its union find
    in the common part; the union has at most ``100 / percent`` times the set's elements. They
    are fewer with a probability below ``miss``.
    """
    n = np.arange(LARGE + 1)
    least = -(-percent * n // 100)
    logs = np.array([lgamma(k + 1) for k in range(LARGE * 100 // percent + 2)])
    t = np.arange(keep + 1)
    for size in range(LARGE + 1):
        union = 100 * size // percent
        if union <= keep:
            continue
        common = -(-percent * union // 100)
        own = t[(t <= common) & (keep - t <= union - common)]
        chance = np.exp(
            logs[common] - logs[own] - logs[common - own] + logs[union - common] - logs[keep - own] - logs[union - common - keep + own]
            - (logs[union] - logs[keep] - logs[union - keep])
        )
        least[size] = min(least[size], own[int(np.searchsorted(np.cumsum(chance), miss, side="right"))])
    # More draws with replacement scatter more: what holds for any number.
    every, total = 0, 0.0
    for k in t.tolist():
        total += np.exp(logs[keep] - logs[k] - logs[keep - k]) * (percent / 100) ** k * (1 - percent / 100) ** (keep - k)
        if total > miss:
            every = k
            break
    return np.append(least, every)


def _signatures(owner: np.ndarray, found: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Size and two sums of hashes of each set; equal sets have equal ones."""
    cut = np.searchsorted(owner, np.arange(n + 1))
    out = {"n": np.diff(cut)}
    for name, salt in (("sig_a", 0), ("sig_b", 0x5851F42D4C957F2D)):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(found ^ U64(salt)), dtype=U64)))
        out[name] = (total[cut[1:]] - total[cut[:-1]]).view(np.int64)
    return out


def sketches(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, keep: int = KEEP) -> DataFrame:
    """Size, signature, bits and bottom-k sketch of every document's set, and what it needs for a link."""
    needs = least_matches(percent, keep)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(dtype=np.int64)
            for first, texts in chunks(batch["text"]):
                owner, found = shingle_sets(texts, size)
                own = _signatures(owner, found, len(texts))
                begin = np.cumsum(own["n"]) - own["n"]
                # One bit less, so that the order is the same with and without a sign.
                values = (found >> U64(1)).view(np.int64)
                least = [values[a : a + min(n, keep)] for a, n in zip(begin.tolist(), own["n"].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": ids[first : first + len(texts)], **own, "need": needs[np.minimum(own["n"], LARGE + 1)], "sketch": least, **_bits(owner, found, len(texts))})

    return docs.mapInPandas(sketch, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, need int, sketch array<bigint>, " + ", ".join(f"{b} bigint" for b in _BITS))


def _classes(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets with their smallest id, and the parts that their rows are dealt into.

    The rows of a set, which may be a third of all, are reduced before each shuffle; SALTS
    parts of them are looked up side by side in the end.
    """
    rows = sketched.filter("n > 0")
    sets = rows.groupBy(*_SIGNATURE).agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("need", "sketch", *_BITS)])
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    parts = rows.select(*_SIGNATURE, _salt()).distinct()
    return sets, parts


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")


def _bits(owner: np.ndarray, found: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """LONGS columns in which each element of a set sets one bit."""
    bits = np.zeros((n, LONGS), dtype=U64)
    np.bitwise_or.at(bits, (owner, ((found >> U64(6)) % U64(LONGS)).astype(np.int64)), U64(1) << (found & U64(63)))
    return dict(zip(_BITS, bits.view(np.int64).T, strict=True))


def _listed(sets: DataFrame) -> DataFrame:
    """The sets that may have a partner, with the values they are listed under (``prefix``).

    Values that no other sketch has are the rarest of all and match nothing; a set is left out if
    too few others remain.
    """
    rows = sets.select("node", F.explode("sketch").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = rows.join(common, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("known"))
    prefix = F.expr("transform(slice(known, 1, size(known) - need + 1), x -> x.h)")
    return sets.join(known, "node").filter("size(known) >= need").withColumn("prefix", prefix).drop("known")


def _apart(x: str, y: str) -> str:
    """SQL: at least so many elements two sets don't share."""
    return " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in _BITS)


def _may_link(x: str, y: str, percent: int) -> str:
    """SQL: neither sizes nor bits of two sets rule out that they are similar enough."""
    both = f"({x}.n + {y}.n)"
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {both} - ({_apart(x, y)}) >= 2 * ceil({percent} * {both} / {100 + percent})"


def union_matches(one: list[np.ndarray], two: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sketches the size of their union's sketch, and how much of it both hold.

    The union of two whole sets, of fewer than ``keep`` values each, counts as a whole.
    """
    sizes = np.array([[len(x), len(y)] for x, y in zip(one, two, strict=True)]).reshape(-1, 2)
    rows = np.full((len(sizes), 2 * keep + 1), np.iinfo(np.int64).max)
    column = np.arange(2 * keep + 1)
    rows[column < sizes[:, :1]] = np.concatenate([*one, np.empty(0, np.int64)])
    rows[(column >= sizes[:, :1]) & (column < sizes.sum(axis=1)[:, None])] = np.concatenate([*two, np.empty(0, np.int64)])
    rows.sort(axis=1)
    again = rows[:, 1:] == rows[:, :-1]
    again &= column[1:] < sizes.sum(axis=1)[:, None]
    size = sizes.sum(axis=1) - again.sum(axis=1)
    size = np.where((sizes < keep).all(axis=1), size, np.minimum(size, keep))
    # The number of distinct values up to each place.
    rank = column[1:] + 1 - np.cumsum(again, axis=1)
    return size, (again & (rank <= size[:, None])).sum(axis=1)


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int, keep: int) -> DataFrame:
    """The pairs (a, b) whose union's sketch doesn't rule a link out, and its estimate."""

    @F.pandas_udf("double")
    def estimate(one: pd.Series, two: pd.Series, need: pd.Series) -> pd.Series:
        size, matches = union_matches(one.tolist(), two.tolist(), keep)
        # Sets that are smaller than a sketch give their similarity itself.
        whole = np.array([len(x) < keep and len(y) < keep for x, y in zip(one, two, strict=True)], dtype=bool)
        enough = np.where(whole, 100 * matches >= percent * size, matches >= need)
        return pd.Series(np.where(enough, matches / np.maximum(size, 1), -1.0))

    left = sets.select(F.col("node").alias("a"), F.col("need").alias("ma"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("need").alias("mb"), F.col("sketch").alias("sb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", estimate("sa", "sb", F.greatest("ma", "mb")).alias("estimate"))
    return found.filter("estimate >= 0")


def _full_sets(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """``node`` and all shingles of ``sets``, from the texts of their first documents."""
    ids = sets.select(F.col("first").alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch["doc_id"].to_numpy(dtype=np.int64)
            for first, texts in chunks(batch["text"]):
                owner, found = shingle_sets(texts, size)
                own = _signatures(owner, found, len(texts))
                cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                found = found.view(np.int64)
                yield pd.DataFrame({"first": names[first : first + len(texts)], **own, "shingles": [found[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    wanted = docs.join(ids, "doc_id", "left_semi")
    found = wanted.mapInPandas(shingles, "first bigint, n bigint, sig_a bigint, sig_b bigint, shingles array<bigint>")
    # Rows that repeat an id have the set of their own text; exact repeats count once.
    return found.join(sets.select("node", "first", *_SIGNATURE), ["first", *_SIGNATURE]).select("node", "n", "shingles").dropDuplicates(["node"])


def _differences(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``pairs`` of nodes ``a`` and ``b`` with the sizes of both sets and ``apart``, how many elements only one of them has."""
    left = full.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = full.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    apart = F.col("na") + F.col("nb") - 2 * F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("apart", apart).drop("sa", "sb")


def _similar(apart: str, both: str, percent: int) -> str:
    """SQL: two sets of ``both`` elements in all that differ in ``apart`` are similar enough."""
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({both})"


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    return _differences(pairs.select("a", "b"), full).filter(_similar("apart", "na + nb", percent)).select("a", "b")


def _radii(known: DataFrame, full: DataFrame) -> DataFrame:
    """``known`` with ``r``, how many elements a set and the first of its component don't share.

    The first set is repeated for the parts that its component's members are dealt into.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    roots = known.select("component", salt).distinct().join(full.select(F.col("node").alias("component"), F.col("n").alias("nr"), F.col("shingles").alias("sr")), "component")
    own = known.select("id", "component", salt).join(full.withColumnRenamed("node", "id"), "id")
    r = F.col("n") + F.col("nr") - 2 * F.size(F.array_intersect("shingles", "sr"))
    return own.join(roots, ["component", "salt"]).select("id", "component", r.alias("r"))


def _spread(facing: DataFrame, sets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets in facing components ``c`` and ``d`` that may link, and the ``gap`` of their bits.

    The number of elements that two sets don't share is a metric. So no member of a component
    is nearer to another's than their first sets are, less the distances of both from these;
    most components are ruled out as a whole, and most members of the others. What is left is
    compared once, not for each list that they share.
    """
    own = [F.max(F.when(F.col("node") == F.col("c"), F.col(b))).alias(b) for b in _BITS]
    whole = sets.groupBy("c").agg(F.max("r").alias("reach"), F.max("n").alias("most"), F.count("*").alias("k"), *own)
    apart = _apart("x", "y")
    pairs = facing.distinct().alias("p").join(whole.alias("x"), F.expr("p.c = x.c"))
    pairs = pairs.join(whole.alias("y"), F.expr(f"p.d = y.c and {_similar(f'{apart} - x.reach - y.reach', 'x.most + y.most', percent)}"))
    # ``c`` is the component with fewer members, which are looked up first.
    small, large = (f"if(x.k {sign} y.k, {{}}, {{}})" for sign in ("<=", ">"))
    ends = [f"{end.format(f'x.{old}', f'y.{old}')} AS {new}" for end, names in ((small, ("a", "cr", "cm")), (large, ("b", "dr", "dm"))) for old, new in zip(("c", "reach", "most"), names, strict=True)]
    near = _differences(pairs.selectExpr(*ends), full).filter(_similar("apart - cr - dr", "cm + dm", percent))
    near = written(near.select(F.col("a").alias("c"), F.col("b").alias("d"), "apart", "dr", "dm"), "near")

    ones = near.alias("f").join(sets.alias("x"), F.expr(f"f.c = x.c and {_similar('abs(f.apart - x.r) - f.dr', 'x.n + f.dm', percent)}"))
    rule = f"f.d = y.c and {_may_link('x', 'y', percent)}"
    for one, two in ("xy", "yx"):
        rule += f" and {_similar(f'abs(f.apart - {one}.r) - {two}.r', 'x.n + y.n', percent)}"
    return ones.join(sets.alias("y"), F.expr(rule)).selectExpr(*_PAIR, f"{_apart('x', 'y')} AS gap")


def _facing(member: DataFrame, percent: int) -> DataFrame:
    """Entries ``a`` and ``b`` of components ``c`` and ``d`` that meet in a list of ``member``.

    The lists of a few members have few pairs. In the others two sets that both stand for
    themselves alone meet once, in the first of the lists in which both do: members of a
    large group share many lists, and the pair would be the same in each.
    """
    lists = member.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"), (F.count("*") > PIVOTS).alias("long"))
    # Lists with one component have nothing left to compare.
    lists = written(lists.filter("least < most").select("h", "long"), "lists")

    def entries(kind: str) -> DataFrame:
        """One member stands for its component in a list, mostly another one in each list."""
        of = member.join(lists.filter(kind).select("h"), "h").groupBy("h", "c")
        return of.agg(F.count("*").alias("members"), *[F.min_by(x, F.xxhash64("h", "node")).alias(x) for x in ("node", "n", *_BITS)])

    def met(rows: DataFrame, once: str) -> DataFrame:
        may = _may_link("x", "y", percent)
        rule = f"x.h = y.h and x.c < y.c and (x.members > 1 or y.members > 1 or {may} and {once})"
        return rows.alias("x").join(rows.alias("y"), F.expr(rule)).selectExpr(*_PAIR, "x.members = 1 and y.members = 1 AS one", f"{may} AS may", f"{_apart('x', 'y')} AS gap")

    long = written(entries("long"), "entries")
    alone = long.filter("members = 1").groupBy("node").agg(F.collect_list("h").alias("alone"))
    long = long.join(alone, "node", "left")
    return met(entries("not long"), "true").union(met(long, "array_min(array_intersect(x.alone, y.alone)) = x.h"))


def _closest(pairs: DataFrame) -> DataFrame:
    """Of each pair of components ``c`` and ``d`` the two sets with the least ``gap``."""
    return pairs.groupBy("c", "d").agg(F.min(F.struct("gap", "a", "b")).alias("m")).select("c", "d", "m.a", "m.b")


def _joined(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs of components, now ``a`` and ``b``, whose given sets are similar enough."""
    return _differences(pairs, full).filter(_similar("apart", "na + nb", percent)).select(F.col("c").alias("a"), F.col("d").alias("b"))


def _still_apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows whose components ``c`` and ``d`` are not in one component by ``links``."""
    merged = connected_components(links)
    apart = rows.select("c", "d").distinct()
    for name in ("c", "d"):
        apart = apart.join(merged.select(F.col("id").alias(name), F.col("component").alias(f"{name}_now")), name, "left")
    apart = apart.filter(F.coalesce("c_now", "c") != F.coalesce("d_now", "d")).select("c", "d")
    return rows.join(apart, ["c", "d"])


def _linked(docs: DataFrame, sets: DataFrame, size: int, percent: int, keep: int) -> DataFrame:
    """``id`` and ``component`` of the sets that have a link.

    First the members of each list are compared with a few pivots; of what passes, each
    set's best estimate is confirmed. Then whatever is not yet in one component is
    compared within all lists: a component in a list is one entry there, so the members
    of a large group of near copies aren't paired with each other, and not with other sets
    that are too far from the first of the group (``_spread``).
    """
    listed = written(_listed(sets), "listed")
    full = written(_full_sets(docs, listed, size), "shingles")
    slim = listed.select("prefix", "node", "n", *_BITS)
    index = slim.select(F.explode("prefix").alias("h"), "node", "n", *_BITS)

    # The first by a hash of the node, so that lists of like members share pivots.
    first = Window.partitionBy("h").orderBy(F.xxhash64("node"), "node")
    pivots = index.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= PIVOTS).drop("k")
    near = index.alias("x").join(pivots.alias("y"), F.expr(f"x.h = y.h and x.node != y.node and {_may_link('x', 'y', percent)}"))
    near = near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    passed = _estimated(near, listed, percent, keep)
    best = passed.groupBy("a").agg(F.max(F.struct("estimate", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    known = written(connected_components(_confirmed(best, full, percent)), "components")

    slim = slim.join(_radii(known, full).withColumnRenamed("id", "node"), "node", "left")
    slim = written(slim.withColumn("c", F.coalesce("component", "node")).withColumn("r", F.coalesce("r", F.lit(0))).drop("component"), "members")
    member = slim.select(F.explode("prefix").alias("h"), "node", "c", "n", *_BITS)
    facing = _facing(member, percent)
    # Two sets may still share many lists.
    facing = written(facing.groupBy("c", "d", "a", "b").agg(*[F.min(x).alias(x) for x in ("one", "may", "gap")]), "facing")

    # The closest two entries of each pair of components first; many are in one component then
    # and need not be spread.
    tried = written(_closest(facing.filter("may")), "tried")
    first = written(_joined(tried, full, percent), "closest")
    left = written(_still_apart(facing, first), "left")
    spread = _spread(left.filter("not one").select("c", "d"), slim.drop("prefix"), full, percent)
    ones = left.filter("one").select("c", "d", "a", "b", "gap")
    rest = written(ones.union(spread).join(tried, ["c", "d", "a", "b"], "left_anti").distinct(), "candidates")

    # Then the closest two of those that are left, and the others where these have no link.
    second = written(_joined(_closest(rest), full, percent), "closest")
    open_pairs = _still_apart(rest, first.union(second)).select("a", "b")
    more = _confirmed(_estimated(open_pairs, listed, percent, keep), full, percent)
    links = first.union(second).union(more)
    return connected_components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    A set holds the distinct ``size``-word shingles of the text, A-Z in lower case; a text
    with fewer words is one shingle. Two documents link when their similarity is at least
    ``percent`` / 100; the component is the smallest id that links reach, and the document
    with this id is kept.

    A null or empty text, or one without words, has an empty set, links with nothing and is kept.
    Rows that repeat an id have one result each; each text is judged for itself, so such a row may
    differ from the others of its id. Rows with a null id have no result. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null")
    sketched = written(sketches(docs, size, percent, KEEP), "sketches")
    sets, parts = _classes(sketched)
    linked = _linked(docs, sets, size, percent, KEEP).withColumnRenamed("id", "node")
    group = sets.join(linked, "node", "left").select(*_SIGNATURE, "first", F.coalesce("component", "node").alias("component"))
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    found = group.join(least, "component").select(*_SIGNATURE, "component_id")
    # Each part of a set's rows finds its component by itself.
    by_part = parts.join(found, [*_SIGNATURE]).select(*_SIGNATURE, "salt", "component_id")
    rows = sketched.select("doc_id", *_SIGNATURE, _salt()).join(by_part, [*_SIGNATURE, "salt"], "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op11_bottom_k(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, and whether it is the one that is kept.

    Null ids have no result; null, empty and wordless texts link with nothing; repeated
    rows have the same result each.
    """
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
