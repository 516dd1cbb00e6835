"""Substring deduplication by Rabin-Karp hashes of all fixed-length word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches
from sumtrail.llm.text import U64, Words, chunks

WORDS = 13
# Bytes of text whose windows are packed together.
PACK_BYTES = 16 << 20
# Documents whose ids agree but for this many low bits are finished together.
BLOCK_BITS = 6

_PACK = "bucket int, hashes binary, owners binary, ids binary, spans binary"
_FOUND = "block bigint, ids binary, hashes binary, spans binary"
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<first: bigint, last: bigint>>"


def _low_bytes(hashes: np.ndarray) -> bytes:
    """The low 56 bits; the bucket implies the others."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(U64)


def _packs(batches: Iterator[pd.DataFrame], size: int):
    """Of up to PACK_BYTES of text: hash, document id and position of every window."""
    parts, total = [], 0
    for batch in batches:
        ids = batch["doc_id"].to_numpy(dtype=np.int64)
        for first, texts in chunks(batch["text"]):
            words = Words(texts, lower=False)
            position, found = words.windows(size)
            owner = np.searchsorted(words.first, position, side="right") - 1
            parts.append((found, ids[first + owner], (position - words.first[owner]).astype(np.int64)))
            total += sum(map(len, texts))
            if total >= PACK_BYTES:
                yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                parts, total = [], 0
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive positions of a document as document, first and number."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], at[begin], at[last] - at[begin] + 1 if len(doc) else at[begin]


def _repeats(docs: DataFrame, size: int) -> DataFrame:
    """For blocks of documents: windows that also start in a document with a smaller id.

    Windows meet by their hash. A task packs the windows of some megabytes of text and
    sends each hash once, with the smallest id that it has seen for it: other documents
    of the pack are known to repeat it. So a bucket gets a common window once for
    each pack and not once for each document. Buckets answer with the hashes that
    occur under a smaller id elsewhere.
    """
    spark = docs.sparkSession
    buckets = 256
    while buckets < 2 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        buckets *= 2
    shift = U64(64 - (buckets.bit_length() - 1))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found, doc, at in _packs(batches, size):
            order = np.argsort(found, kind="stable")
            found, doc, at = found[order], doc[order], at[order]
            begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.empty(0, np.int64)
            length = np.diff(np.append(begin, len(found)))
            least = np.minimum.reduceat(doc, begin) if len(begin) else doc[:0]
            later = doc > np.repeat(least, length)
            rows = []
            own, first, n = _runs(doc[later], at[later])
            cut = np.flatnonzero(np.concatenate(([True], own[1:] >> BLOCK_BITS != own[:-1] >> BLOCK_BITS, [True]))) if len(own) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                spans = np.stack((own[a:b], first[a:b], n[a:b]), axis=1)
                rows.append({"bucket": int(own[a] >> BLOCK_BITS) % buckets, "hashes": b"", "owners": b"", "ids": b"", "spans": spans.tobytes()})
            found = found[begin]
            bucket = (found >> shift).astype(np.int64)
            # By document within a bucket: ids then take few bytes.
            order = np.lexsort((least, bucket))
            found, least, bucket = found[order], least[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[k], cut[k + 1]
                ids, where = np.unique(least[a:b], return_inverse=True)
                steps = np.diff(where, prepend=0).astype(np.uint8)
                rows.append({"bucket": k, "hashes": _low_bytes(found[a:b]), "owners": steps.tobytes(), "ids": ids.tobytes(), "spans": b""})
            yield pd.DataFrame(rows, columns=["bucket", "hashes", "owners", "ids", "spans"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        rows, hashes, owners = [], [], []
        for r in group.itertuples():
            if r.spans:
                block = int(np.frombuffer(r.spans, dtype=np.int64)[0]) >> BLOCK_BITS
                rows.append({"block": block, "ids": b"", "hashes": b"", "spans": r.spans})
                continue
            where = np.cumsum(np.frombuffer(r.owners, dtype=np.uint8).astype(np.int64))
            owners.append(np.frombuffer(r.ids, dtype=np.int64)[where])
            hashes.append(_from_low_bytes(r.hashes))
        if hashes:
            found, doc = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(found, kind="stable")
            found, doc = found[order], doc[order]
            begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(found))))
            later = doc > least
            found, doc = found[later] | (U64(group["bucket"].iloc[0]) << shift), doc[later]
            order = np.argsort(doc, kind="stable")
            found, doc = found[order], doc[order]
            block = doc >> BLOCK_BITS
            cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows.append({"block": int(block[a]), "ids": doc[a:b].tobytes(), "hashes": found[a:b].tobytes(), "spans": b""})
        return pd.DataFrame(rows, columns=["block", "ids", "hashes", "spans"])

    packed = docs.select("doc_id", "text").mapInPandas(pack, _PACK)
    return packed.groupBy("bucket").applyInPandas(compare, _FOUND)


def _finish(size: int):
    def finish(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        hashes: dict[int, list[np.ndarray]] = {}
        spans: dict[int, list[np.ndarray]] = {}
        for r in found.itertuples():
            if r.spans:
                for doc, first, n in np.frombuffer(r.spans, dtype=np.int64).reshape(-1, 3):
                    spans.setdefault(int(doc), []).append((first, n))
                continue
            ids = np.frombuffer(r.ids, dtype=np.int64)
            own = np.frombuffer(r.hashes, dtype=U64)
            cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                hashes.setdefault(int(ids[a]), []).append(own[a:b])
        rows = []
        for doc, text in zip(docs["doc_id"].tolist(), docs["text"], strict=True):
            words = Words([text.encode() if isinstance(text, str) else b""], lower=False)
            n = len(words.hash)
            change = np.zeros(n + 1, dtype=np.int64)
            if doc in hashes:
                position, own = words.windows(size)
                at = position[np.isin(own, np.concatenate(hashes[doc]))]
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
            for first, k in spans.get(doc, ()):
                change[first] += 1
                change[first + k + size - 1] -= 1
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            kept = [words.data[a:b] for a, b in zip(words.start[~gone].tolist(), words.end[~gone].tolist(), strict=True)]
            rows.append({
                "doc_id": doc, "n_words": n, "n_removed": int(gone.sum()), "kept": b" ".join(kept).decode(),
                "removed": [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[0::2], edge[1::2], strict=True)],
            })
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "removed"])

    return finish


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """Remove word windows that also start in a document with a smaller id.

    Every window of ``size`` words of the given texts is judged; removed words merge into
    maximal intervals. Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words
    left, joined by one space) and ``removed`` (first and last word of each interval).

    A null or empty text has no words, and one with fewer than ``size`` loses none. Rows
    that repeat an id don't count as smaller than each other. Rows with a null id have no
    order and no result. Other columns are not read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null")
    found = _repeats(docs, size)
    blocks = docs.withColumn("block", F.expr(f"shiftright(doc_id, {BLOCK_BITS})"))
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_finish(size), _RESULT)


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated 13-word windows are removed."""
    small_batches(spark)
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
