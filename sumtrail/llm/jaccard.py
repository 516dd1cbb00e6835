"""Jaccard join on word n-grams by a grouped prefix join.

A pair of sets with similarity of 0.75 or more has a common element among the first
``n - ceil(0.75 n) + 1`` of each set, in any fixed order. Documents whose prefixes and
sizes agree form a group; groups are paired by common prefix elements and filtered
by size, position and bitmap; the members of the pairs left are verified exactly.

Two steps before that keep the join small without losing a pair. Documents with
equal sets are one class, joined through its smallest id. And a document can only be
linked if at most a quarter of its set is its own alone, which a count of short
fingerprints bounds from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.components import connected_components
from sumtrail.llm.folders import small_batches, written
from sumtrail.llm.text import U64, Words, chunks, mix, release, text_of

WORDS = 5
PERCENT = 75
# Sets are compared by this many bits before they are compared exactly.
BITMAP_LONGS = 8
# Members of a list that all others are compared with first.
PIVOTS = 6
# Parts into which the rows of one key are dealt while their least id is found.
SALTS = 32
# Bytes of text that are packed together in the screen.
PACK_BYTES = 12 << 20
# Up to so many ids are broadcast; more are shuffled.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of each text, sorted."""
    words = Words(texts, lower=True)
    position, found = words.windows(size)
    owner = text_of(position, words.first)
    n = np.diff(words.first)
    short = []
    for k in range(1, size):  # the whole text is its one shingle
        own = np.flatnonzero(n == k)
        if len(own):
            total = np.zeros(len(own), dtype=U64)
            for i in range(k):
                total = mix(total + words.hash[words.first[own] + i])
            short.append((own, mix(total + U64(k))))
    if short:
        owner = np.concatenate([owner, *(o for o, _ in short)])
        found = np.concatenate([found, *(h for _, h in short)])
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found[lo:hi].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new]


def _packs(batches: Iterator[pd.DataFrame], size: int):
    """Ids, text numbers and shingles of up to PACK_BYTES of text at a time."""
    ids, owners, found, total = [], [], [], 0
    for batch in batches:
        own = batch["doc_id"].to_numpy(dtype=np.int64)
        for first, texts in chunks(batch["text"]):
            owner, h = shingle_sets(texts, size)
            owners.append(owner + sum(map(len, ids)))
            found.append(h)
            ids.append(own[first : first + len(texts)])
            total += sum(map(len, texts))
            if total >= PACK_BYTES:
                yield np.concatenate(ids), np.concatenate(owners), np.concatenate(found)
                ids, owners, found, total = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(owners), np.concatenate(found)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by owner, modulo 2^64; owners are sorted."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


_PACK = "bucket int, prints binary, owners binary, ids binary, shared binary, n binary, m binary, sig_a binary, sig_b binary"
_STAT = "doc_id bigint, shared bigint, n bigint, m bigint, sig_a bigint, sig_b bigint"


def _screen(docs: DataFrame, size: int) -> DataFrame:
    """Per document its set's size and signature, and whether it may have a partner.

    Of the shingles, the half with an even hash is looked at: ``m`` of a document's
    ``n``, of which ``shared`` occur in other documents too. If more than a quarter of
    ``n`` is not shared, the document has no partner. Fingerprints of 32 bits beside the
    bucket can only make ``shared`` too large. Of a shingle that several documents of a
    pack have, one entry without owner is sent, so common ones make no large bucket.
    """
    spark = docs.sparkSession
    buckets = 64
    while buckets < 2 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        buckets *= 2
    bits = buckets.bit_length() - 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, owner, found in _packs(batches, size):
            n = np.bincount(owner, minlength=len(ids))
            half = (found & U64(1)) == 0
            own, key = owner[half], found[half] >> U64(32 - bits)
            key &= U64((1 << (32 + bits)) - 1)
            order = np.argsort(key, kind="stable")
            own, key = own[order].astype(np.uint32), key[order]
            begin = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
            at = np.flatnonzero(begin)
            several = np.diff(np.append(at, len(key))) > 1
            shared = np.bincount(own[np.repeat(several, np.diff(np.append(at, len(key))))], minlength=len(ids))
            yield pd.DataFrame([{
                "bucket": int(ids[0]) % buckets, "prints": b"", "owners": b"", "ids": ids.tobytes(),
                "shared": shared.astype(np.int64).tobytes(), "n": n.astype(np.int64).tobytes(),
                "m": np.bincount(owner[half], minlength=len(ids)).astype(np.int64).tobytes(),
                "sig_a": _sums(owner, mix(found), len(ids)).tobytes(),
                "sig_b": _sums(owner, mix(found ^ U64(0x5851F42D4C957F2D)), len(ids)).tobytes(),
            }])
            key, own = key[at], own[at]
            own[several] = np.uint32(0xFFFFFFFF)
            place = (key >> U64(32)).astype(np.int64)
            # By owner within a bucket: owners then compress well.
            order = np.lexsort((own, place))
            key, own, place = key[order].astype(np.uint32), own[order], place[order]
            cut = np.searchsorted(place, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                lo, hi = cut[b], cut[b + 1]
                if lo == hi:
                    continue
                few, where = np.unique(own[lo:hi], return_inverse=True)
                named = np.append(ids, 0)[np.minimum(few, len(ids))]
                rows.append({
                    "bucket": b, "prints": key[lo:hi].tobytes(),
                    "owners": np.diff(where, prepend=0).astype(np.uint8).tobytes(),
                    "ids": np.concatenate((named, [int(few[-1] == 0xFFFFFFFF)])).tobytes(),
                    "shared": b"", "n": b"", "m": b"", "sig_a": b"", "sig_b": b"",
                })
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PACK.split(", ")])
        release()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        stats, prints, owners = [], [], []
        for row in group.itertuples():
            ids = np.frombuffer(row.ids, dtype=np.int64)
            if row.n:
                column = lambda c: np.frombuffer(getattr(row, c), dtype=np.int64)  # noqa: B023, E731
                stats.append(pd.DataFrame({"doc_id": ids} | {c: column(c) for c in ("shared", "n", "m", "sig_a", "sig_b")}))
                continue
            where = np.cumsum(np.frombuffer(row.owners, dtype=np.uint8).astype(np.int64))
            named = len(ids) - 1 - ids[-1]  # the last owner may stand for several documents
            prints.append(np.frombuffer(row.prints, dtype=np.uint32))
            owners.append((ids[where], where < named))
        if prints:
            key = np.concatenate(prints)
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = np.concatenate(([False], key[1:] == key[:-1], [False]))
            hit = np.empty(len(key), dtype=bool)
            hit[order] = same[1:] | same[:-1]
            hit &= np.concatenate([k for _, k in owners])
            ids, n = np.unique(np.concatenate([o for o, _ in owners])[hit], return_counts=True)
            stats.append(pd.DataFrame({"doc_id": ids, "shared": n, "n": 0, "m": 0, "sig_a": 0, "sig_b": 0}))
        return pd.concat(stats) if stats else pd.DataFrame(columns=["doc_id", "shared", "n", "m", "sig_a", "sig_b"])

    packed = docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(pack, _PACK)
    counted = packed.groupBy("bucket").applyInPandas(count, _STAT)
    stats = counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.max(F.struct("n", "m", "sig_a", "sig_b")).alias("s"))
    spare = F.expr(f"n - ceil({PERCENT} * n / 100)")
    return stats.select("doc_id", "shared", "s.*").withColumn("alive", (F.col("n") > 0) & (F.col("m") - F.col("shared") <= spare))


def _with_least(rows: DataFrame, key: list[str], least: str, count: str) -> DataFrame:
    """Add the least ``doc_id`` and the number of the rows with the same ``key``.

    The rows of a key are dealt into SALTS parts, each is reduced to one row, and what
    is found for the key goes back to those parts, so a key with very many rows is in no
    single task.
    """
    dealt = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)"))
    parts = dealt.groupBy(*key, "salt").agg(F.min("doc_id").alias(least), F.count("*").alias(count))
    whole = parts.groupBy(*key).agg(F.min(least).alias(least), F.sum(count).alias(count), F.collect_list("salt").alias("salts"))
    back = whole.select(*key, least, count, F.explode("salts").alias("salt"))
    return dealt.join(back, [*key, "salt"]).drop("salt")


def _member_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Shingles and bitmap of the documents in ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["doc_id"].to_numpy(dtype=np.int64)
            for first, texts in chunks(batch["text"]):
                owner, found = shingle_sets(texts, size)
                bits = np.zeros((len(texts), BITMAP_LONGS), dtype=U64)
                place = (found >> U64(6)) % U64(BITMAP_LONGS)
                np.bitwise_or.at(bits, (owner, place.astype(np.int64)), U64(1) << (found & U64(63)))
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                found = found.view(np.int64)
                yield pd.DataFrame({
                    "doc_id": own[first : first + len(texts)], "bitmap": list(bits.view(np.int64)),
                    "shingles": [found[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
                })

    return wanted.mapInPandas(sets, "doc_id bigint, bitmap array<bigint>, shingles array<bigint>")


def _prefixes(sets: DataFrame) -> DataFrame:
    """For each document its shared shingles and its prefix, rarest elements first.

    Shingles that no other document has come first in the order and never match, so
    they are counted (``lone``) but not kept. Documents with too many are dropped.
    """
    rows = sets.select("doc_id", F.explode("shingles").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = rows.join(common, "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("known"))
    return (
        sets.select("doc_id", "bitmap", F.size("shingles").alias("n"))
        .join(known, "doc_id")
        .withColumn("need", F.expr(f"cast(ceil({PERCENT} * n / 100) as int)"))
        .filter("size(known) >= need")
        .withColumn("lone", F.expr("n - size(known)"))
        .withColumn("shingles", F.expr("transform(known, x -> x.h)"))
        .withColumn("prefix", F.expr("slice(shingles, 1, n - need + 1 - lone)"))
        .drop("known", "need")
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared exactly."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(f"100 * i >= {PERCENT} * (na + nb - i)").select("a", "b")


def _too_far(x: str, y: str) -> str:
    """SQL: the bitmaps of two documents rule out that they are similar enough."""
    apart = " + ".join(f"bit_count({x}.bitmap[{k}] ^ {y}.bitmap[{k}])" for k in range(BITMAP_LONGS))
    return f"{x}.n + {y}.n - ({apart}) < 2 * ceil({PERCENT} * ({x}.n + {y}.n) / {100 + PERCENT})"


def _linked(sets: DataFrame) -> DataFrame:
    """``id`` and ``component`` of the documents in ``sets`` that have a link.

    First every group is compared with a few pivots of each of its prefix elements, and
    every member with the first of its group. Then all pairs are compared that are
    not in one component by these links. So members of a large group of copies take a
    few comparisons each, and no link between different components is missed.
    """
    sets = written(sets, "sets")
    grouped = _with_least(sets.select("doc_id", "n", "prefix", "bitmap"), ["n", "prefix"], "gid", "members")
    member = written(grouped.select("doc_id", "gid", "members", "n", "bitmap"), "members")
    heads = sets.drop("bitmap").join(member.filter("doc_id = gid").select("doc_id", "gid", "members", "bitmap"), "doc_id")
    index = written(heads.select("gid", "members", "n", "lone", "bitmap", F.posexplode("prefix").alias("at", "h")), "prefixes")

    # Pivots are the least by several hashes of the id, so lists of like members share them.
    pivots = index.groupBy("h").agg(*[F.min(F.struct(F.xxhash64("gid", F.lit(k)), "gid")).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = pivots.select("h", F.array_distinct(F.array(*[f"p{k}.gid" for k in range(PIVOTS)])).alias("pivots"))
    to_pivot = index.join(pivots, "h").select(F.col("gid").alias("a"), F.explode("pivots").alias("b"))
    to_head = member.select(F.col("doc_id").alias("a"), F.col("gid").alias("b"))
    pairs = to_pivot.union(to_head).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = (
        pairs.join(member.alias("x"), F.col("a") == F.col("x.doc_id"))
        .join(member.alias("y"), F.col("b") == F.col("y.doc_id"))
        .filter(f"100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) and not ({_too_far('x', 'y')})")
        .select("a", "b")
    )
    known = written(connected_components(_verified(pairs, sets)), "components")

    part = known.withColumnRenamed("id", "doc_id")
    member = written(member.join(part, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "members")
    parts = member.groupBy("gid").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    index = index.join(parts, "gid").withColumn("one", F.expr("least = most"))
    near = F.expr(
        "x.h = y.h and (x.n < y.n or x.n = y.n and (x.gid < y.gid or x.gid = y.gid and not x.one))"
        " and not (x.one and y.one and x.least = y.least)"
        f" and 100 * x.n >= {PERCENT} * y.n"
        f" and least(x.n - x.lone - x.at, y.n - y.lone - y.at) >= ceil({PERCENT} * (x.n + y.n) / {100 + PERCENT})"
        f" and not (x.members = 1 and y.members = 1 and {_too_far('x', 'y')})"
    )
    group_pairs = index.alias("x").join(index.alias("y"), near).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("k")).distinct()
    expanded = (
        group_pairs.join(member.alias("x"), F.col("g") == F.col("x.gid"))
        .join(member.alias("y"), (F.col("k") == F.col("y.gid")) & F.expr(f"x.component != y.component and not ({_too_far('x', 'y')})"))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    )
    more = _verified(expanded.distinct(), sets)
    both = known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
    return connected_components(both)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    A set holds the distinct ``size``-word shingles of the text, A-Z in lower case; a
    text with fewer words is one shingle, a null text or one without words has an
    empty set and links with nothing. Two documents link when their similarity is at
    least 0.75; the component is the smallest id reached by links.

    Rows with a null id have no result. An id has one result for each of its different texts, which
    are judged for themselves; rows that repeat id and text count once. Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null")
    if _distinct(docs):
        return _components(docs, size)
    rows = written(docs.dropDuplicates().withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _components(rows.select(F.col("row").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def _distinct(docs: DataFrame) -> bool:
    """Whether no two rows have the same id."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0


def _components(docs: DataFrame, size: int) -> DataFrame:
    """As ``jaccard_components``, for documents with distinct ids."""
    stats = written(_screen(docs, size), "screen")
    alive = stats.filter("alive")
    first = written(_with_least(alive, ["n", "sig_a", "sig_b"], "first", "copies").select("doc_id", "first"), "classes")
    chosen = first.filter("doc_id = first").select("doc_id")
    sets = written(_member_sets(docs, chosen, size), "shingles")
    parts = _linked(_prefixes(sets)).withColumnRenamed("id", "first")
    component = first.join(parts, "first", "left").select("doc_id", F.coalesce("component", "first").alias("component_id"))
    found = stats.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document.

    Nulls, short texts and repeated rows are handled as ``jaccard_components`` says.
    """
    small_batches(spark)
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, that with the smallest id, and rows without id.

    Rows that repeat an id are told apart by a number, and one of each component stays.
    """
    small_batches(spark)
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.filter("doc_id is not null").select("doc_id")
    if _distinct(named):
        extra = jaccard_components(docs).filter("doc_id != component_id").select("doc_id")
        return docs.join(extra, "doc_id", "left_anti").select(*own)
    rows = written(docs.select(*own, F.monotonically_increasing_id().alias("__row")), "rows")
    given = rows.filter("doc_id is not null")
    found = jaccard_components(given, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    chosen = found.join(given.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("least"))
    keep = chosen.select(F.col("least.__row").alias("__row"))
    return given.join(keep, "__row", "left_semi").select(*own).union(rows.filter("doc_id is null").select(*own))
