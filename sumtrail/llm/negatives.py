"""Hard negatives by angular triangle filtering.

Every vector is stored with its norm and its angles to a few reference directions. For two vectors
the angles to one reference bound the angle between them: it is at least their difference,
and at most their sum. The cosines of these bounds times the norms, widened
by what rounding can amount to, bound the score, which is computed, as an integer, only where the bounds
overlap the window of scores that is asked for.

Vectors are packed in parts of bounded size, anchors in blocks of bounded size, and
each block meets each part in one group: no task holds more than one of either.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches, written

SCALE = 256
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
# A negative's score is at least so many percent of the positive's.
PERCENT = 80
REFERENCES = 16
# Numbers of elements that get references; vectors of others are scored without a filter.
LENGTHS = 8
PART_ROWS = 1 << 15
BLOCK_ANCHORS = 1 << 12
# Rounding of an angle, relative rounding of cosine times norms, and of norms.
SLACK = 1e-6
# Integers up to here, and sums of them, are exact as doubles.
EXACT = 2**53

_PACK = "length int, ids binary, labels binary, values binary, norms binary, angles binary"


def _packed(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, references: dict[int, np.ndarray]) -> dict:
    """Vectors of one length as columns of bytes."""
    # The norm is widened for scores; angles are those of the vectors themselves.
    norms = np.sqrt((values * values).sum(axis=1))
    unit = values / np.where(norms > 0, norms, 1)[:, None]
    own = references.get(values.shape[1], np.empty((0, values.shape[1])))
    angles = np.arccos(np.clip(unit @ own.T, -1, 1))
    return {
        "length": values.shape[1], "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "values": values.astype("<f8").tobytes(),
        "norms": norms.astype("<f8").tobytes(), "angles": angles.astype("<f8").tobytes(),
    }


class Pack:
    def __init__(self, row) -> None:
        self.ids, self.labels, self.norms = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), np.frombuffer(row.norms, "<f8")
        self.values = np.frombuffer(row.values, "<f8").reshape(len(self.ids), row.length)
        self.angles = np.frombuffer(row.angles, "<f8").reshape(len(self.ids), -1)
        if len(self.norms) and self.norms.max() >= 2**31:
            raise ValueError(f"a vector's norm is {self.norms.max():g} after scaling: scores may not fit into 64 bits")

    def bounds(self, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each vector can have with one of these angles and norm."""
        if not self.angles.shape[1]:
            most = self.norms * norm * (1 + SLACK) + 1
            return -most, most
        apart = np.abs(self.angles - angles).max(axis=1) - SLACK
        total = self.angles + angles
        widest = np.minimum(total, 2 * math.pi - total).min(axis=1) + SLACK
        size = self.norms * norm
        slack = SLACK * size + 1
        return np.cos(np.minimum(widest, math.pi)) * size - slack, np.cos(np.maximum(apart, 0)) * size + slack

    def scores(self, which: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
        """Inner products, as integers without rounding."""
        own = self.values[which]
        if len(which) and self.norms[which].max() * norm < EXACT / 2:
            return (own @ vector).astype(np.int64)  # no sum of products reaches 2^53
        return own.astype(np.int64) @ vector.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` largest scores; of equal ones the smaller id comes first."""
    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_positives(anchors: Pack, part: Pack, k: int = POSITIVES) -> tuple[list[tuple[int, int, int]], int]:
    """Anchor's number, id and score of its ``k`` nearest of the same label; and how many were scored."""
    out, scored = [], 0
    for a in range(len(anchors.ids)):
        own = np.flatnonzero((part.labels == anchors.labels[a]) & (part.ids != anchors.ids[a]))
        low, high = (b[own] for b in part.bounds(anchors.angles[a], anchors.norms[a]))
        if len(own) > k:
            # k of them reach this score for certain.
            own = own[high >= np.partition(low, len(low) - k)[len(low) - k]]
        s = part.scores(own, anchors.values[a], anchors.norms[a])
        scored += len(own)
        out += [(a, int(part.ids[own[i]]), int(s[i])) for i in _best(s, part.ids[own], k)]
    return out, scored


def window(score: int, percent: int = PERCENT) -> tuple[int, int]:
    """Least and largest score of a negative; none if the first is larger."""
    return -(-percent * score // 100), score


def best_negatives(anchors: Pack, part: Pack, wanted: dict[int, list[tuple[int, int]]], k: int = NEGATIVES) -> tuple[list[tuple[int, int, int, int]], int]:
    """Anchor's number, number of the positive, id and score of the ``k`` first within its window.

    ``wanted`` has numbers and scores of the positives by anchor.
    """
    out, scored = [], 0
    for a, positives in wanted.items():
        windows = [(p, *window(s)) for p, s in positives]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            continue
        low, high = part.bounds(anchors.angles[a], anchors.norms[a])
        reached = np.zeros(len(part.ids), dtype=bool)
        for _, least, most in windows:
            reached |= (high >= least) & (low <= most)
        own = np.flatnonzero(reached & (part.labels != anchors.labels[a]) & (part.ids != anchors.ids[a]))
        s = part.scores(own, anchors.values[a], anchors.norms[a])
        scored += len(own)
        order = np.lexsort((part.ids[own], -s))
        down = -s[order]
        for p, least, most in windows:
            begin, end = np.searchsorted(down, -most, side="left"), np.searchsorted(down, -least, side="right")
            out += [(a, p, int(part.ids[own[i]]), int(s[i])) for i in order[begin : min(end, begin + k)]]
    return out, scored


def _vectors(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    chosen = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return chosen.filter(f"id is not null and label is not null and v is not null and {finite}")


def _references(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For the LENGTHS most frequent lengths the directions of the ``count`` vectors with the least hashed ids."""
    lengths = [r["l"] for r in vectors.groupBy(F.size("v").alias("l")).count().orderBy(F.desc("count"), "l").limit(LENGTHS).collect()]
    out = {}
    for n in lengths:
        rows = vectors.filter(F.size("v") == n).orderBy(F.xxhash64("id"), "id", "label", "v").select("v").limit(count).collect()
        values = np.floor(SCALE * np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), n))
        norms = np.sqrt((values * values).sum(axis=1))
        out[n] = values[norms > 0] / norms[norms > 0, None]
    return out


def _in_packs(vectors: DataFrame, name: str, n: int, references: dict[int, np.ndarray]) -> DataFrame:
    """Vectors dealt by hashed id into ``n`` packs, numbered from 0, of one length each."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "label"], kind="stable")
        size = group["v"].map(len)
        rows = []
        for length, own in group.groupby(size):
            values = np.floor(SCALE * np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), length))
            rows.append({name: int(group[name].iloc[0])} | _packed(own["id"].to_numpy(), own["label"].to_numpy(), values, references))
        return pd.DataFrame(rows)

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return written(dealt.groupBy(name).applyInPandas(pack, f"{name} int, {_PACK}"), name)


def _each_pair(blocks: DataFrame, parts: DataFrame, n_blocks: int, n_parts: int):
    """Every block of anchors together with every part of the vectors, as co-groups."""
    one = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    two = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return one.groupBy("block", "part").cogroup(two.groupBy("block", "part"))


def _matching(one: pd.DataFrame, two: pd.DataFrame):
    """Anchors and vectors of equal length; a block has one row for each."""
    parts = {r.length: r for r in two.itertuples()}
    for row in one.itertuples():
        if row.length in parts:
            yield row, Pack(row), Pack(parts[row.length])


def mine_negatives(rows: DataFrame, anchors: str = "id % 100 = 0", vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", references: int = REFERENCES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Vectors are scaled by 256 and rounded down; a score is the inner product of the integers.
    An anchor's positives are the POSITIVES highest scores of its label, for each of which the
    NEGATIVES highest scores of other labels from 80 % of the positive's score up to it are
    returned; of equal scores the smaller id comes first. ``anchors`` is SQL on ``id``.

    Rows with a null id or label, a null vector, or a null or infinite component or NaN take no part. Vectors are
    compared with those of their length only. Rows with an anchor's id are never its
    positives or negatives; apart from that, rows that repeat an id count one by one. Norms of 2^31 and more
    are an error, as scores might not fit into 64 bits. An empty table gives an empty
    result. Columns other than the three named are not read.
    """
    vectors = _vectors(rows, vec_id, vector, label)
    asked = vectors.filter(anchors)
    # At least a part for each partition, so that every core has work.
    n_parts = max(math.ceil(vectors.count() / PART_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_blocks = max(1, math.ceil(asked.count() / BLOCK_ANCHORS))
    directions = _references(vectors, references)
    parts, blocks = _in_packs(vectors, "part", n_parts, directions), _in_packs(asked, "block", n_blocks, directions)

    key = ["block", "length", "at"]

    def positives(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [(row.block, row.length, *x) for row, own, part in _matching(one, two) for x in best_positives(own, part)[0]]
        return pd.DataFrame(out, columns=[*key, "id", "score"])

    found = _each_pair(blocks, parts, n_blocks, n_parts).applyInPandas(positives, "block int, length int, at int, id bigint, score bigint")
    first = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    chosen = written(found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= POSITIVES), "positives")
    # Every block has its anchors' positives, of which there are at most POSITIVES each.
    wanted = chosen.groupBy("block", "length").agg(F.collect_list(F.struct("at", "place", "score")).alias("wanted"))
    blocks = blocks.join(wanted, ["block", "length"])

    def negatives(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, own, part in _matching(one, two):
            asked: dict[int, list[tuple[int, int]]] = {}
            for w in row.wanted:
                asked.setdefault(w["at"], []).append((w["place"], w["score"]))
            out += [(row.block, row.length, a, int(own.ids[a]), *x) for a, *x in best_negatives(own, part, asked)[0]]
        return pd.DataFrame(out, columns=[*key, "anchor_id", "place", "negative_id", "negative_score"])

    mined = _each_pair(blocks, parts, n_blocks, n_parts).applyInPandas(
        negatives, "block int, length int, at int, anchor_id bigint, place int, negative_id bigint, negative_score bigint"
    )
    order = Window.partitionBy(*key, "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    both = mined.join(chosen.select(*key, "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), [*key, "place"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; of every seventh the label is changed first.

    Nulls, ties, repeats and an empty table are handled as ``mine_negatives`` says.
    """
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved))
