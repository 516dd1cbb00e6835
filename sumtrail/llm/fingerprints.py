"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for every prefix of a text, its polynomial modulo the prime 2^31 - 1
to two bases. The difference of two entries is the hash of a span, so any two spans
can be compared, and the longest common extension found by binary search. A
fingerprint is the text's length and hash, and the smallest hashes of its spans of
SPAN code points; the likeness of two fingerprints estimates how much of these agree.
Texts of fewer than SHORT code points, of which an edit leaves few such spans, also have
the smallest hashes of their spans of SHORT_SPANS code points, and are compared by these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches
from sumtrail.llm.ordered import by_range, range_number
from sumtrail.llm.text import U64, mix

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_693)
SPAN = 24
SKETCH = 32
SHORT = 4 * SPAN
SHORT_SPANS = (2, 4, 8)
_P, _S = U64(PRIME), U64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime; for a Mersenne prime by shifts."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, as many as were ever needed."""

    def __init__(self, base: int) -> None:
        self.power = np.array([1, base], dtype=U64)
        self.inverse = np.array([1, pow(base, -1, PRIME)], dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.power) < n:
            for name in ("power", "inverse"):
                old = getattr(self, name)
                step = _reduced(old[-1:] * old[1:2])
                setattr(self, name, np.concatenate((old, _reduced(old * step))))
        return self.power, self.inverse


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Hashes of every prefix of ``text``; memory grows with the text, 16 bytes a code point."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64) + U64(1)
        self.n = len(codes)
        self.prefix = []
        for p in _POWERS:
            total = np.zeros(self.n + 1, dtype=U64)
            np.cumsum(_reduced(codes * p.upto(self.n + 1)[0][: self.n]), out=total[1:])
            self.prefix.append(_reduced(total))

    def span(self, begin: int, end: int) -> tuple[int, ...]:
        """The hash of a span, which depends on its code points alone."""
        return tuple(
            (int(g[end]) - int(g[begin])) * int(p.upto(self.n + 1)[1][begin]) % PRIME for g, p in zip(self.prefix, _POWERS, strict=True)
        )

    def equal(self, begin: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(begin, begin + length) == other.span(at, at + length)

    def common_extension(self, begin: int, other: PrefixHash, at: int) -> int:
        """How many code points from ``begin`` on equal those of ``other`` from ``at`` on."""
        low, high = 0, min(self.n - begin, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(begin, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int = SPAN) -> np.ndarray:
        """A 32-bit hash of every span of ``length`` code points."""
        if self.n < length:
            return np.empty(0, dtype=np.uint32)
        own = []
        for g, p in zip(self.prefix, _POWERS, strict=True):
            own.append(_reduced(_reduced(g[length:] + _P - g[:-length]) * p.upto(self.n + 1)[1][: self.n - length + 1]))
        return (mix((own[0] << _S) | own[1]) >> U64(32)).astype(np.uint32)


def _least(values: np.ndarray, k: int = SKETCH) -> np.ndarray:
    if len(values) > 64 * k:
        few = np.unique(values[values < np.uint32((1 << 32) * 8 * k // len(values))])
        if len(few) >= k:
            return few[:k]
    return np.unique(values)[:k]


def _written(n: int, whole: tuple[int, ...], *sketches: np.ndarray) -> str:
    return "-".join((f"{n:x}", f"{whole[0]:08x}{whole[1]:08x}", *(s.astype(">u4").tobytes().hex() for s in sketches)))


def _short(hashes: PrefixHash) -> list[np.ndarray]:
    """The sketch that only short texts have."""
    return [_least(np.concatenate([hashes.spans(k) for k in SHORT_SPANS]))] if hashes.n < SHORT else []


def likeness(one: str, two: str) -> float:
    """Between 0 and 1: the estimated share of spans that two texts have in common.

    1 for equal fingerprints, those of empty texts too. Two short texts are compared by their
    short spans; one of fewer than SPAN code points has nothing in common with a text that
    isn't short.
    """
    if one == two:
        return 1.0
    # The last sketch that both have.
    parts = [x.split("-")[2:] for x in (one, two)]
    k = min(map(len, parts)) - 1
    a, b = (np.frombuffer(bytes.fromhex(p[k]), dtype=">u4") for p in parts)
    union = np.unique(np.concatenate((a, b)))[:SKETCH]
    if not len(union):
        return 0.0
    return float(np.isin(union, np.intersect1d(a, b)).mean())


class Fingerprint:
    """A text with its prefix hashes and fingerprint."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.hash = PrefixHash(text)
        self.spans = self.hash.spans()
        self.written = _written(self.hash.n, self.hash.span(0, self.hash.n), _least(self.spans), *_short(self.hash))

    def edited(self, following: Fingerprint) -> tuple[str, str]:
        """Text and fingerprint when the second half is replaced by the start of another.

        Spans within either part have the hashes that they have in their own texts; only
        those across the seam are new.
        """
        keep = self.hash.n - self.hash.n // 2
        take = min(self.hash.n // 2, following.hash.n)
        text = self.text[:keep] + following.text[:take]
        whole = []
        for mine, theirs, p in zip(self.hash.prefix, following.hash.prefix, _POWERS, strict=True):
            whole.append((int(mine[keep]) + int(theirs[take]) * int(p.upto(keep + 1)[0][keep])) % PRIME)
        seam = PrefixHash(text[max(0, keep - SPAN + 1) : keep + SPAN - 1]).spans()
        own, other = self.spans[: max(0, keep - SPAN + 1)], following.spans[: max(0, take - SPAN + 1)]
        short = _short(PrefixHash(text)) if keep + take < SHORT else []
        return text, _written(keep + take, tuple(whole), _least(np.concatenate((own, seam, other))), *short)


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix bigint"
)


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how they compare.

    In the edited text the last ``n // 2`` code points give way to the first as many of
    the next document's, by ascending id; the first follows the last. A null text counts as
    empty. Rows that repeat an id follow each other in the order of their texts. Rows
    with a null id have no place in the order and no result. Other columns are not read.

    Rows are dealt out by ranges of the id. Each range also gets the first row of the next
    one, so the text is moved once and no task sees more than its range.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("doc_id is not null")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = range_number(rows, "doc_id", n)
    firsts = rows.select("doc_id", number.alias("range")).groupBy("range").agg(F.min("doc_id").alias("doc_id")).orderBy("range").collect()
    # One row for each range, of which there are as many as partitions.
    guests = [(r["doc_id"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    guest = F.broadcast(spark.createDataFrame(guests, "doc_id bigint, before int"))
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest")))
    )
    dealt = rows.withColumn("range", number).join(guest, "doc_id", "left").select("doc_id", "text", F.explode(places).alias("p"))
    dealt = dealt.select("doc_id", "text", "p.range", "p.guest")
    dealt = by_range(dealt, n).sortWithinPartitions("range", "guest", "doc_id", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            out = []
            for name, value, r, is_guest in zip(batch["doc_id"], batch["text"], batch["range"], batch["guest"], strict=True):
                if is_guest and (before is None or before[2]):
                    continue  # another row with the first id of the next range
                now = Fingerprint(value)
                if before is not None and before[1] == r and not before[2]:
                    own = before[3]
                    edited, written = own.edited(now)
                    out.append((
                        before[0], own.hash.n, hashlib.sha256(edited.encode()).hexdigest(), own.written, written,
                        likeness(own.written, written), likeness(own.written, now.written), own.hash.common_extension(0, now.hash, 0),
                    ))
                before = name, r, is_guest, now
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return dealt.mapInPandas(compare, _RESULT)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    small_batches(spark)
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
