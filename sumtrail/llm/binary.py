"""Token ids in files, compressed by a static range asymmetric numeral system.

A group holds the ids of some whole documents and one frequency table. Its ids are cut
into blocks of LANES x STEPS; each block has LANES interleaved states, so that it can be
decoded for itself: the file keeps a checkpoint (final states, place in the stream) and
a checksum for each. Groups are rows of a table that Spark writes, so a lost task leaves
no half-written file, and any store that Spark can write to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.llm.bpe import default_path, encoder
from sumtrail.llm.folders import shared_folder, small_batches
from sumtrail.llm.ordered import by_range, range_number
from sumtrail.llm.text import U64

LANES = 32
STEPS = 256
PRECISION = 20
# Ids of a group, unless its last document has more.
GROUP_IDS = 1 << 20
END_ID = 2
# Code points that are encoded together, and one more text.
BATCH_CHARS = 1 << 20
_LOW = U64(1 << 31)

FILE = (
    "range int, number int, start bigint, doc_ids binary, lengths binary, symbols binary, frequencies binary, "
    "states binary, places binary, checksums binary, stream binary"
)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """``counts``, all positive, scaled to sum to ``2 ** PRECISION``, each at least 1."""
    scaled = np.maximum(1, counts * (1 << PRECISION) // counts.sum())
    while excess := int(scaled.sum()) - (1 << PRECISION):
        if excess < 0:
            scaled[counts.argmax()] -= excess
            continue
        for k in np.argsort(-scaled, kind="stable"):
            cut = min(int(scaled[k]) // 2, excess)
            scaled[k] -= cut
            excess -= cut
            if not excess:
                break
    return scaled


def encode_ids(ids: np.ndarray) -> dict[str, bytes]:
    """Table, checkpoints, checksums and stream of the ids of a group."""
    every = np.bincount(ids)
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    place = np.zeros(len(every), dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    index = place[ids]
    size = LANES * STEPS
    blocks = -(-len(ids) // size)
    freq = frequencies(counts) if len(ids) else counts
    start = np.concatenate(([0], np.cumsum(freq)[:-1])) if len(ids) else counts
    padded = np.full(blocks * size, counts.argmax() if len(ids) else 0)
    padded[: len(ids)] = index
    padded = padded.reshape(blocks, STEPS, LANES)
    f, c = freq.astype(U64), start.astype(U64)
    state = np.full((blocks, LANES), _LOW, dtype=U64)
    words = np.empty((STEPS, blocks, LANES), dtype=np.uint32)
    out = np.empty((STEPS, blocks, LANES), dtype=bool)
    for t in range(STEPS - 1, -1, -1):
        which = padded[:, t, :]
        own = f[which]
        full = out[t] = state >= own << U64(63 - PRECISION)
        words[t] = state.astype(np.uint32)
        state = np.where(full, state >> U64(32), state)
        high = state // own
        state = (high << U64(PRECISION)) + (state - high * own) + c[which]
    by_block, out = words.transpose(1, 0, 2), out.transpose(1, 0, 2)
    data = ids.astype("<u4")
    return {
        "symbols": symbols.astype("<u4").tobytes(), "frequencies": freq.astype("<u4").tobytes(), "states": state.astype("<u8").tobytes(),
        "places": np.concatenate(([0], np.cumsum(out.sum(axis=(1, 2))))).astype("<u8").tobytes(),
        "checksums": np.array([zlib.crc32(data[k : k + size].tobytes()) for k in range(0, len(ids), size)], dtype="<u4").tobytes(),
        "stream": by_block[out].astype("<u4").tobytes(),
    }


def decode_ids(row, n: int, blocks: range | None = None) -> np.ndarray:
    """The ids of ``blocks`` (by default all) of a group of ``n`` ids.

    Raises ValueError if the ids don't have the checksum that was written with them.
    """
    size = LANES * STEPS
    symbols, freq = np.frombuffer(row.symbols, "<u4"), np.frombuffer(row.frequencies, "<u4").astype(U64)
    places, sums = np.frombuffer(row.places, "<u8").astype(np.int64), np.frombuffer(row.checksums, "<u4")
    blocks = range(len(sums)) if blocks is None else blocks
    if not len(blocks):
        return np.empty(0, dtype=np.uint32)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U64)
    slot = np.repeat(np.arange(len(freq)), freq.astype(np.int64))
    state = np.frombuffer(row.states, "<u8").reshape(-1, LANES)[blocks.start : blocks.stop].astype(U64)
    stream = np.append(np.frombuffer(row.stream, "<u4"), np.uint32(0)).astype(U64)
    at = places[blocks.start : blocks.stop].copy()
    found = np.empty((len(blocks), STEPS, LANES), dtype=np.int64)
    mask = U64((1 << PRECISION) - 1)
    for t in range(STEPS):
        low = state & mask
        which = found[:, t, :] = slot[low.astype(np.int64)]
        state = freq[which] * (state >> U64(PRECISION)) + low - start[which]
        need = state < _LOW
        order = np.cumsum(need, axis=1)
        take = np.minimum(at[:, None] + order - 1, len(stream) - 1)
        state = np.where(need, (state << U64(32)) | stream[take], state)
        at += order[:, -1]
    ids = symbols[found.reshape(-1)][: max(0, n - blocks.start * size)]
    for k in blocks:
        own = ids[(k - blocks.start) * size : (k - blocks.start + 1) * size]
        if zlib.crc32(own.astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"block {k} of range {row.range}, group {row.number}: wrong checksum")
    return ids


def write_token_files(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode the texts in ascending order of ``doc_id`` and write them to ``folder``.

    A null or empty text has the end id only. Rows that repeat an id follow each other in
    the order of their texts; rows with a null id have no place and are left out.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = by_range(rows.withColumn("range", range_number(rows, "doc_id", n)), n).sortWithinPartitions("range", "doc_id", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        names, parts, held, place = [], [], 0, {"range": None, "number": 0, "start": 0}

        def some(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
            """Texts that are encoded together, and the place of the first."""
            first, size, out = 0, 0, []
            for k, text in enumerate(texts):
                if size >= BATCH_CHARS:
                    yield first, out
                    first, size, out = k, 0, []
                out.append(text if isinstance(text, str) else "")
                size += len(out[-1])
            if out:
                yield first, out

        def group() -> pd.DataFrame:
            lengths = np.array([len(p) for p in parts], dtype="<u4")
            row = place | {"doc_ids": np.array(names, dtype="<i8").tobytes(), "lengths": lengths.tobytes()} | encode_ids(np.concatenate(parts))
            place.update(number=place["number"] + 1, start=place["start"] + int(lengths.sum()))
            return pd.DataFrame([row])

        for batch in batches:
            ranges, ids = batch["range"].tolist(), batch["doc_id"].tolist()
            for first, texts in some(batch["text"]):
                for k, own in enumerate(enc.batch_ids(texts), first):
                    if parts and (ranges[k] != place["range"] or held >= GROUP_IDS):
                        yield group()
                        names, parts, held = [], [], 0
                    if ranges[k] != place["range"]:
                        place.update(range=ranges[k], number=0, start=0)
                    own = np.append(own, end_id).astype(np.uint32)
                    names.append(ids[k])
                    parts.append(own)
                    held += len(own)
        enc.rest()
        if parts:
            yield group()

    rows.mapInPandas(encode, FILE).write.parquet(folder)


def read_token_files(spark, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of every document in the files.

    Groups are decoded side by side; every block is held against its checksum.
    """
    files = spark.read.parquet(folder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                ids = decode_ids(row, int(ends[-1])).astype("<u4")
                yield pd.DataFrame({
                    "doc_id": np.frombuffer(row.doc_ids, "<i8"), "range": row.range, "place": row.start + ends - lengths, "n_tokens": lengths,
                    "ids": [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)],
                })

    ids = files.mapInPandas(decode, "doc_id bigint, range int, place bigint, n_tokens bigint, ids binary")
    # One row for each range, of which there are as many as partitions.
    length = F.expr("octet_length(doc_ids)")
    last = files.groupBy("range").agg(F.max(F.struct("start", "lengths", length.alias("l"))).alias("m"))

    @F.pandas_udf("bigint")
    def total(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: int(np.frombuffer(x, "<u4").sum(dtype=np.int64)))

    sums = last.select("range", (F.col("m.start") + total(F.col("m.lengths"))).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("range", F.coalesce(before, F.lit(0)).alias("base"))
    return ids.join(F.broadcast(bases), "range").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the files."""
    small_batches(spark)
    folder = shared_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_path())
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
