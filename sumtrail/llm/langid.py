"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumtrail.llm.folders import small_batches, written
from sumtrail.llm.text import release

PROFILE = 300
LONGEST = 3
UNDETERMINED = "und"
# Texts are taken together up to this many code points.
CHUNK_CHARS = 1 << 18
_BITS = 21  # a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def _normal(text: str) -> np.ndarray:
    """Lower-case letters with one space before, between and after the words."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.full(len(raw) + 2, 32, dtype=np.uint32)
    chars[1:-1] = _letters()[raw]
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    chars = chars[keep]
    return chars if len(chars) > 1 else chars[:0]


def _grams(chars: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, n-gram) in order, and how often each occurs.

    N-grams have 1 to 3 letters, or begin or end with the space at a word's edge.
    An n-gram is an integer of three code points; absent ones are 0. Its order is that
    of the letters, so ties between equal counts break alike everywhere.
    """
    alphabet, code = np.unique(chars, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    code = code.astype(np.int64) + 1
    space = chars == 32
    base = group.astype(np.int64) << (3 * bits)
    keys = [(base | (code << (2 * bits)))[~space]]
    if len(chars) > 1:
        ok = (group[1:] == group[:-1]) & ~(space[1:] & space[:-1])
        two = base[:-1] | (code[:-1] << (2 * bits)) | (code[1:] << bits)
        keys.append(two[ok])
    if len(chars) > 2:
        ok = (group[2:] == group[:-2]) & ~space[1:-1]
        keys.append((two[:-1] | code[2:])[ok])
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    points = np.concatenate(([0], alphabet.astype(np.int64)))
    mask = (1 << bits) - 1
    gram = (points[(key >> (2 * bits)) & mask] << (2 * _BITS)) | (points[(key >> bits) & mask] << _BITS) | points[key & mask]
    return key >> (3 * bits), gram, count


def _counted(texts: Sequence[str | None], labels: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """n-gram counts by text, or by label, of consecutive texts: first, number, group, gram, count."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        chars = _normal(text) if isinstance(text, str) else np.empty(0, np.uint32)
        if len(chars) > CHUNK_CHARS:
            if parts:
                yield from _flush(first, parts, labels)
            yield i, 1, *_long(chars, 0 if labels is None else labels[i])
            first, parts, size = i + 1, [], 0
            continue
        if size + len(chars) > CHUNK_CHARS or len(parts) == 4096:
            yield from _flush(first, parts, labels)
            first, parts, size = i, [], 0
        parts.append(chars)
        size += len(chars)
    if parts:
        yield from _flush(first, parts, labels)


def _flush(first, parts, labels):
    own = np.arange(len(parts)) if labels is None else labels[first : first + len(parts)]
    group = np.repeat(own, [len(p) for p in parts])
    # Each text begins and ends with a space, so no n-gram spans two texts of one label.
    yield first, len(parts), *_grams(np.concatenate(parts), group)


def _long(chars: np.ndarray, group: int):
    """Counts of one long text, piece by piece; pieces overlap at a space."""
    spaces = np.flatnonzero(chars == 32)
    grams, counts, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while at < len(chars) - 1:
        k = np.searchsorted(spaces, at + CHUNK_CHARS, side="right") - 1
        end = spaces[k] if spaces[k] > at else spaces[k + 1]
        piece = chars[at : end + 1]
        _, g, c = _grams(piece, np.zeros(len(piece), np.int64))
        both, where = np.unique(np.concatenate((grams, g)), return_inverse=True)
        counts = np.bincount(where, np.concatenate((counts, c)), len(both)).astype(np.int64)
        grams, at = both, end
    return np.full(len(grams), group, np.int64), grams, counts


def _top(group: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the ``k`` most frequent n-grams of each group, and their ranks from 0."""
    order = np.lexsort((-count, group))  # stable: equal counts stay in n-gram order
    own = group[order]
    begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    keep = rank < k
    return order[keep], rank[keep]


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, most frequent first.

    Counts cover every given row; rows without text or language give none. Tasks add up
    their rows before the shuffle, so a language with most of the rows is no hot key.
    The result has ``size`` integers for each distinct language and nothing else.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names, labels = np.unique(batch["lang"].to_numpy(dtype=str), return_inverse=True)
            found: dict[int, list] = {}
            for _, _, group, gram, n in _counted(batch["text"].tolist(), labels):
                for g in np.unique(group):
                    lo, hi = np.searchsorted(group, [g, g + 1])
                    found.setdefault(int(g), []).append((gram[lo:hi], n[lo:hi]))
            for g, parts in found.items():
                name = str(names[g])
                parts += [total[name]] if name in total else []
                grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total[name] = grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
        for name, (grams, n) in total.items():
            yield pd.DataFrame({"lang": name, "gram": grams, "n": n})
        total.clear()
        release()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counts = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= size)
    profiles: dict[str, dict[int, int]] = {}
    for r in top.collect():
        profiles.setdefault(r["lang"], {})[r["rank"]] = r["gram"]
    return {name: [ranks[k] for k in sorted(ranks)] for name, ranks in sorted(profiles.items())}


class Identifier:
    """Out-of-place distance of texts to language profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.array([g for n in self.names for g in profiles[n]], dtype=np.int64))
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def __call__(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        The distance adds, over the text's n-grams, how many places the rank differs
        from the profile's, or ``size`` if the profile lacks the n-gram. The score is
        1 minus the distance over the largest possible one. Of equally near
        languages the first by name is taken.
        """
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.names:
            return langs, scores
        for first, n, group, gram, count in _counted(texts):
            at, rank = _top(group, count, self.size)
            group, gram = group[at], gram[at]
            where = np.searchsorted(self.grams, gram)
            where[(where == len(self.grams)) | (self.grams[np.minimum(where, len(self.grams) - 1)] != gram)] = len(self.grams)
            own = np.bincount(group, minlength=n)
            distance = np.empty((len(self.names), n))
            for i in range(len(self.names)):
                theirs = self.rank[i, where]
                place = np.where(theirs < 0, self.size, np.minimum(np.abs(theirs - rank), self.size))
                distance[i] = np.bincount(group, place, n)
            best = distance.argmin(axis=0)
            for d in np.flatnonzero(own):
                langs[first + d] = self.names[best[d]]
                scores[first + d] = 1 - distance[best[d], d] / (own[d] * self.size)
        return langs, scores


def identify_languages(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE, into: tuple[str, str] = ("lang_pred", "lang_score")
) -> DataFrame:
    """Add the language and its score to ``docs``, replacing columns of these names (``into``).

    Texts that are null, empty or without a letter get ``und`` and 0; so does every text
    if there are no profiles. Whole texts count, long ones piece by piece. Of equally near languages
    the first by name is taken. Repeated rows have the same result each.
    """
    schema = "lang_pred string, lang_score double"

    @F.pandas_udf(schema)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        identifier = Identifier(profiles, size)
        for batch in batches:
            langs, scores = identifier(batch.tolist())
            yield pd.DataFrame({"lang_pred": langs, "lang_score": scores})
        release()

    others = [F.col(f"`{c}`") for c in docs.columns if c not in into]
    found = docs.select(*others, identify(F.col(f"`{text}`")).alias("__lang"))
    return found.select(*others, F.col("__lang.lang_pred").alias(into[0]), F.col("__lang.lang_score").alias(into[1]))


def bucket(doc_id: str, n: int):
    """crc32 of the id as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the documents.

    A null text, or one without a letter, is ``und`` with score 0. Ties go to the first language by
    name; repeated rows have a result each; a null id counts as the empty text for the split.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = bucket("doc_id", 3) == 1
    profiles = language_profiles(docs.filter(~held_out))
    found = identify_languages(docs.withColumn("held_out", held_out).drop("lang"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


# A text is in none of the languages if its score is below the lower quartile of its
# language's documents by more than so many times the distance from there to their median.
MARGIN = 5
# A language with fewer documents shares the scores of all; with fewer in all, LEAST_SCORE holds.
LEAST_ROWS = 100
LEAST_SCORE = 0.05
# Scores are counted in steps of one over this.
STEPS = 1000


def least_scores(found: DataFrame, languages: list[str], lang: str = "lang", into: tuple[str, str] = ("lang_pred", "lang_score")) -> dict[str, float]:
    """For each language the least score that its texts can have, from all labelled rows.

    ``found`` are identified rows. A row counts if it is found to be in the language that it is labelled
    with. Quartiles stay where they are while less than a quarter of a language's rows are something else.
    """
    pred, score = F.col(f"`{into[0]}`"), F.col(f"`{into[1]}`")
    own = found.filter(F.col(f"`{lang}`") == pred).groupBy(pred.alias("lang"), F.floor(score * STEPS).cast("int").alias("step"))
    counts = {name: np.zeros(STEPS + 1, dtype=np.int64) for name in languages}
    for r in own.agg(F.count("*").alias("n")).collect():
        counts[r["lang"]][r["step"]] += r["n"]

    def least(n: np.ndarray) -> float:
        if n.sum() < LEAST_ROWS:
            return LEAST_SCORE
        low, middle = np.searchsorted(np.cumsum(n), [n.sum() / 4, n.sum() / 2]) / STEPS
        return max(LEAST_SCORE, float(low - MARGIN * (middle - low)))

    everything = sum(counts.values(), np.zeros(STEPS + 1, dtype=np.int64))
    return {name: least(n if n.sum() >= LEAST_ROWS else everything) for name, n in counts.items()}


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: without letters, or far from every profile.

    The documents are identified once and written; thresholds and the result come from that table.
    Without any labelled text, all with a letter stay. Repeated rows stay or go together.
    """
    small_batches(spark)
    profiles = language_profiles(docs)
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    into = ("__lang_pred", "__lang_score")
    found = written(identify_languages(docs, profiles, into=into), "languages")
    least = F.create_map(*[F.lit(x) for pair in least_scores(found, list(profiles), into=into).items() for x in pair])
    known = (F.col(into[0]) != UNDETERMINED) & (F.col(into[1]) >= least[F.col(into[0])])
    return found.filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])
