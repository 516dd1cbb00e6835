"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a text that is as long as some benchmark item, and has enough of the
items' shingles that it could be similar to one at all, gets a SimHash fingerprint; a text
shorter than the item is one window. A
multi-index over blocks of the fingerprints' bits finds every item within the radius:
of two fingerprints that differ in at most RADIUS of 64 bits, one of the BLOCKS blocks
differs in at most RADIUS // BLOCKS bits. What is found is compared exactly, by the
weighted similarity of shingles (each weighs as often as it occurs).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches
from sumtrail.llm.text import U64, Words, chunks, mix, release, text_of

WORDS = 5
SIMILARITY = 0.75
RADIUS = 20
BLOCKS = 7
# Items are sent to the tasks in blocks of about this many bytes of text.
BLOCK_BYTES = 4 << 20

MATCH = "array<struct<item_id: bigint, similarity: double, distance: int, first_word: bigint, n_words: int>>"


def simhash(shingles: np.ndarray) -> int:
    """Bit k is set if more of the shingles have bit k set than not."""
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)
    return int(np.packbits(votes, bitorder="little").view(U64)[0])


def weighted_similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Sum of the lesser over the sum of the greater number of times a shingle occurs."""
    a, n = np.unique(one, return_counts=True)
    b, m = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(one) + len(two) - common)


class MultiIndex:
    """Finds all fingerprints within ``radius`` of one."""

    def __init__(self, prints: list[int], radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.prints, self.radius = prints, radius
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.parts = [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.flips = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            near = [0]
            for k in range(1, radius // blocks + 1):
                near += [sum(1 << b for b in c) for c in combinations(range(hi - lo), k)]
            self.flips.append(near)
        self.tables: list[dict[int, list[int]]] = [{} for _ in self.parts]
        for i, p in enumerate(prints):
            for table, (lo, mask) in zip(self.tables, self.parts, strict=True):
                table.setdefault((p >> lo) & mask, []).append(i)

    def near(self, p: int) -> list[tuple[int, int]]:
        """Number and distance of each."""
        found = set()
        for table, (lo, mask), flips in zip(self.tables, self.parts, self.flips, strict=True):
            own = (p >> lo) & mask
            for flip in flips:
                found.update(table.get(own ^ flip, ()))
        out = [(i, (self.prints[i] ^ p).bit_count()) for i in sorted(found)]
        return [(i, d) for i, d in out if d <= self.radius]


class Benchmark:
    """Items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> None:
        self.similarity = similarity
        self.ids, self.shingles, sizes, prints = [], [], [], []
        for item_id, text in items:
            words = Words([text.encode()] if text else [b""], lower=True)
            n = len(words.hash)
            if n:
                self.ids.append(item_id)
                self.shingles.append(words.windows(min(WORDS, n))[1])
                sizes.append(n)
                prints.append(simhash(self.shingles[-1]))
        self.index = MultiIndex(prints)
        self.known = {}
        for g in {min(WORDS, s) for s in sizes}:
            own = [i for i, s in enumerate(sizes) if min(WORDS, s) == g]
            distinct = [np.unique(self.shingles[i]) for i in own]
            shingle = np.concatenate(distinct)
            item = np.repeat(own, [len(d) for d in distinct])
            order = np.argsort(shingle, kind="stable")
            shingle, item = shingle[order], item[order]
            low = np.zeros(1 << 20, dtype=bool)
            low[(shingle & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.known[g] = shingle, item, low

    def matches(self, texts: list[bytes]) -> list[list[dict]]:
        """For each text the best window for each item that it has."""
        words = Words(texts, lower=True)
        best: list[dict] = [{} for _ in texts]
        for g, (shingle, item, low) in self.known.items():
            position, found = words.windows(g)
            at = np.flatnonzero(low[(found & U64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(shingle, found[at], side="left"), np.searchsorted(shingle, found[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            which = item[np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
            at = np.repeat(at, n)
            owner = text_of(position[at], words.first)
            order = np.lexsort((at, which, owner))
            at, which, owner = at[order], which[order], owner[order]
            new = (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])
            cut = np.concatenate(([0], np.flatnonzero(new) + 1, [len(at)]))
            bounds = np.searchsorted(position, words.first)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                d = int(owner[a])
                self._windows(found[bounds[d] : bounds[d + 1]], at[a:b] - bounds[d], int(which[a]), g, best[d])
        return [[{"item_id": self.ids[i], **m} for i, m in sorted(b.items())] for b in best]

    def _windows(self, found: np.ndarray, at: np.ndarray, item: int, g: int, best: dict) -> None:
        """Look up the windows of an item's size that hold enough of its shingles, at ``at``.

        A text that has fewer shingles than the item is one window.
        """
        size = len(self.shingles[item])
        n = min(size, len(found))
        # So many shingles must be common for the similarity.
        least = math.ceil((n + size) * self.similarity / (1 + self.similarity) - 1e-9)
        if len(at) < least:
            return
        first = np.arange(max(0, at[0] - n + 1), min(at[-1], len(found) - n) + 1)
        held = np.searchsorted(at, first + n) - np.searchsorted(at, first)
        for start in first[held >= least].tolist():
            window = found[start : start + n]
            for i, distance in self.index.near(simhash(window)):
                s = weighted_similarity(window, self.shingles[i])
                if s >= self.similarity and s > best.get(i, {"similarity": 0})["similarity"]:
                    best[i] = {"similarity": s, "distance": distance, "first_word": start, "n_words": n + g - 1}


def _found(text: Column, items: list[tuple[int, str | None]], similarity: float) -> Column:
    @F.pandas_udf(MATCH)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        benchmark = Benchmark(items, similarity)
        for batch in batches:
            out: list = []
            for _, texts in chunks(batch):
                out += benchmark.matches(texts)
            yield pd.Series(out, dtype=object)
        release()

    return search(text)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, into: str = "matches"
) -> DataFrame:
    """Add ``matches`` (or ``into``), one entry for each item that a window of the text is similar to.

    A column of that name is replaced. A text shorter than an item is compared as a
    whole. Null and empty texts have none; items that are null, empty or without words match nothing,
    and repeated items match each for itself. Words are compared with A-Z in lower case;
    an item of fewer than five words is one shingle.

    Items reach the tasks in blocks of bounded size, each compared with all texts, so a
    large benchmark takes more passes and not more memory.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna(subset=["t"])
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    others = [F.col(f"`{c}`") for c in docs.columns if c != into]
    found = []
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t")
        found.append(_found(F.col(f"`{text}`"), [tuple(r) for r in block.collect()], similarity))
    return docs.select(*others, F.concat(*found).alias(into))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    small_batches(spark)
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__matches")
    return found.filter(F.size("__matches") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
