"""BPE encoding by tree concatenation, and decoding.

A text is halved until the pieces are short; each piece is encoded by itself, and a
piece's end may be wrong because the text goes on. At every join a window around it is
encoded anew, twice as wide each time, until it has a token boundary with the same
tokens before and after it in common with the left side, and another with the right.
Between these two boundaries the window's tokens replace those of the sides.

Normalisation composes and reorders characters, so no cut (of a leaf, part or window) is made
within a run of characters that it may join to the one before; see ``cut_before``.

Texts of more than ``PART_CHARS`` code points are cut into rows first, so several tasks
encode one text; their results are joined in the same way, pair by pair.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches
from sumtrail.llm.text import release

LEAF_CHARS = 4096
PART_CHARS = 1 << 16
# First width of the window on either side of a join.
WINDOW_CHARS = 32
# Words whose tokens a task remembers at a time, those of them that it met first, which
# stay when room is made, and the longest.
MEMO_WORDS = 400_000
MEMO_KEPT = 250_000
MEMO_CHARS = 64
# Words that a worker keeps from one task to the next.
REST_WORDS = 150_000

# Punctuation that often follows a word; after a letter it is a word of its own.
_CLOSING = b".,;:!?#*$%&"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.array([bytes((c,)).isalpha() for c in range(256)])
_ENDS = np.isin(np.arange(256), np.frombuffer(_CLOSING, np.uint8))


def _joined(char: str) -> bool:
    """Whether normalisation may combine ``char`` with what stands before it.

    Marks, the vowels and finals of Hangul, and characters that this Unicode version doesn't know.
    """
    return char >= "\u0300" and (unicodedata.category(char) in ("Mn", "Mc", "Me", "Cn") or "\u1160" <= char <= "\u11ff")


def cut_before(text: str, at: int, least: int = 0) -> int:
    """The last place from ``least`` to ``at`` where ``text`` may be cut; ``least`` if there is none."""
    while least < at < len(text) and _joined(text[at]):
        at -= 1
    return at


def cut_after(text: str, at: int) -> int:
    """The first place from ``at`` on where ``text`` may be cut; its end if there is none."""
    while at < len(text) and _joined(text[at]):
        at += 1
    return at


class Tokens:
    """Token ids with the code points of the text that each stands for."""

    __slots__ = ("ids", "start", "end")

    def __init__(self, ids, start, end) -> None:
        self.ids, self.start, self.end = np.asarray(ids, np.int32), np.asarray(start, np.int64), np.asarray(end, np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def _concat(parts: Sequence[Tokens]) -> Tokens:
    return Tokens(*(np.concatenate([getattr(p, c) for p in parts]) for c in Tokens.__slots__))


class TreeEncoder:
    """Encodes texts as the library does with ``add_special_tokens=False``."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A window that is cut inside a special token must reach past it.
        special = max([0, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.leaf, self.window = leaf, max(window, 2 * special)
        self.names = None
        if self.tokenizer.decoder is None:  # then decoding puts spaces between tokens
            self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        # Where nothing but the model acts on a lower-case ASCII word, the model is asked directly.
        probe = ("abcdefghijklmnopqrstuvwxyz" * 3)[:MEMO_CHARS]
        whole = self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(probe) == probe
        whole &= self.tokenizer.pre_tokenizer is not None and self.tokenizer.pre_tokenizer.pre_tokenize_str(probe) == [(probe, (0, MEMO_CHARS))]
        whole &= not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model if whole and getattr(self.tokenizer.model, "dropout", None) is None else None
        # Letters that a token stands for, if it is of ASCII letters.
        suffix = getattr(self.model, "end_of_word_suffix", None) or ""
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.sizes = np.array([len(x.removesuffix(suffix)) for x in names], dtype=np.int32)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.spans = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.first, self.used = np.zeros(1 << 16, np.int64), 0

    def _make_room(self, wanted: int) -> None:
        keep = min(len(self.number), MEMO_KEPT, max(0, MEMO_WORDS - wanted))
        self.number = dict(islice(self.number.items(), keep))
        self.used = int(self.first[keep])

    def _store(self, words: list[bytes], n: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> None:
        """Add words of ``n`` tokens each, whose ids and spans follow each other."""
        count, used = len(self.number), self.used + len(ids)
        if used > len(self.ids):
            self.ids, self.spans = (np.concatenate((x, np.zeros(2 * used - len(x), np.int32))) for x in (self.ids, self.spans))
        if count + len(words) >= len(self.first):
            self.first = np.concatenate((self.first, np.zeros(2 * (count + len(words)) + 1 - len(self.first), np.int64)))
        self.ids[self.used : used], self.spans[self.used : used] = ids, spans
        self.first[count + 1 : count + 1 + len(words)] = self.used + np.cumsum(n)
        self.number.update(zip(words, range(count, count + len(words)), strict=True))
        self.used = used

    def _learn(self, words: list[bytes]) -> None:
        """Have the library encode the parts of ``words`` that are not known yet.

        Punctuation after a letter is a part of its own, since the library splits there,
        and a word of ASCII letters has the tokens of its lower case.
        """
        letters = [w for w in words if w.isalpha()]  # of bytes: ASCII letters
        lower = [w.lower() for w in letters]
        plain, fresh = dict.fromkeys(lower), {}
        whole = [w for w, core in zip(letters, lower, strict=True) if w != core]
        cores = [w.lower() for w in whole]
        rests, shifts = [b""] * len(whole), [len(w) for w in whole]
        for word in words:
            if word.isalpha():
                continue
            core = word.rstrip(_CLOSING)
            if core.isalpha():
                size, core = len(core), core.lower()
                plain[core] = None
            else:
                if core != word and core:
                    text = core.decode()
                    if text[-1].lower().isalpha():
                        size = len(text)
                    else:
                        core = word
                else:
                    core = word
                fresh[core] = None
            rest = word[len(core) :]
            if rest:
                fresh[rest] = None
                whole.append(word)
                cores.append(core)
                rests.append(rest)
                shifts.append(size)
        known = self.number
        asked = [w for w in plain if w not in known]
        new = (asked if self.model is None else self._learn_plain(asked)) + [w for w in fresh if w not in known]
        if new:
            texts = [w.decode() for w in new]
            e = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in texts)])
            spans = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
            n = np.diff(np.searchsorted(spans[:, 0], begins))
            spans -= np.repeat(begins[:-1], n)[:, None]
            # Start and end in one integer; words are short.
            self._store(new, n, np.array(e.ids, dtype=np.int32), (spans[:, 0] << 16) | spans[:, 1])
        keep = [k for k, w in enumerate(whole) if w not in self.number]
        if keep:
            parts = np.stack((
                np.fromiter((self.number[cores[k]] for k in keep), np.int64, len(keep)),
                np.fromiter((self.number[rests[k]] if rests[k] else -1 for k in keep), np.int64, len(keep)),
            ), axis=1)
            lo = np.where(parts < 0, 0, self.first[parts])
            n = np.where(parts < 0, 0, self.first[parts + 1] - lo)
            flat = n.ravel()
            take = np.arange(flat.sum()) + np.repeat(lo.ravel() - np.concatenate(([0], np.cumsum(flat)[:-1])), flat)
            shift = np.zeros_like(n)
            shift[:, 1] = np.array([shifts[k] for k in keep]) * 0x10001
            self._store([whole[k] for k in keep], n.sum(axis=1), self.ids[take], self.spans[take] + np.repeat(shift.ravel(), flat))

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Have the model encode lower-case words of ASCII letters; those that its tokens don't cover are returned."""
        encode = self.model.tokenize
        found = [[t.id for t in encode(w.decode())] for w in words]
        n = np.fromiter(map(len, found), np.int64, len(words))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
        total = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        first = np.concatenate(([0], np.cumsum(n)))
        begins = total[first]
        fits = np.diff(begins) == np.fromiter(map(len, words), np.int64, len(words))
        start, end = total[:-1] - np.repeat(begins[:-1], n), total[1:] - np.repeat(begins[:-1], n)
        own = np.repeat(fits, n)
        if fits.all():
            self._store(words, n, ids, (start << 16) | end)
            return []
        self._store([w for w, fit in zip(words, fits, strict=True) if fit], n[fits], ids[own], ((start << 16) | end)[own])
        return [w for w, fit in zip(words, fits, strict=True) if not fit]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The places of words in the memo, after learning those that are new."""
        which = list(map(self.number.get, words))
        if None in which:
            at = [i for i, k in enumerate(which) if k is None]
            missing = dict.fromkeys([words[i] for i in at])
            if len(self.number) + 2 * len(missing) > MEMO_WORDS:
                self._make_room(2 * len(missing))
                at, missing = range(len(words)), dict.fromkeys(w for w in words if w not in self.number)
            self._learn(list(missing))
            for i in at:
                which[i] = self.number[words[i]]
        return np.array(which, dtype=np.int64)

    def rest(self) -> None:
        """Between tasks only the words that were met first are remembered."""
        self.number = dict(islice(self.number.items(), REST_WORDS))
        self.used = int(self.first[len(self.number)])
        self.ids, self.spans = self.ids[: self.used].copy(), self.spans[: self.used].copy()
        self.first = self.first[: len(self.number) + 1].copy()
        release()

    def batch_ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids alone of some texts, word by word; texts with very long words go through the tree."""
        data = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join(data), dtype=np.uint8)
        # The library splits between a letter and punctuation, so the latter is a word of its own.
        split = np.flatnonzero(_ENDS[raw[1:]] & _LETTER[raw[:-1]]) + 1
        begins = np.cumsum([0, *(len(t) + 1 for t in data)])
        begins += np.searchsorted(split, begins)
        raw = np.insert(raw, split, 0x20)
        space = np.ones(len(raw) + 2, dtype=bool)
        space[1:-1] = _SPACE[raw]
        change = np.flatnonzero(space[1:] != space[:-1])
        first = np.searchsorted(change[0::2], begins)
        sizes = change[1::2] - change[0::2]
        large = np.flatnonzero(sizes > MEMO_CHARS)
        long = {k: self.tokens(texts[k]).ids for k in np.unique(np.searchsorted(first, large, side="right") - 1).tolist()}
        if long:
            keep = np.ones(len(sizes), dtype=bool)
            for k in long:
                keep[first[k] : first[k + 1]] = False
                if first[k] < first[k + 1]:
                    space[change[2 * first[k]] + 1 : change[2 * first[k + 1] - 1] + 1] = True
            sizes = sizes[keep]
            first = np.concatenate(([0], np.cumsum(keep)))[first]
        # Each different word is looked up once.
        ends = np.concatenate(([0], np.cumsum(sizes)))
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[~space[1:-1]])]).dictionary_encode()
        which = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        lo = self.first[which]
        n = self.first[which + 1] - lo
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], n)]
        cut = ends[first]
        return [long[k] if k in long else ids[a:b] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def word_ids(self, text: str) -> np.ndarray:
        return self.batch_ids([text])[0]

    def _direct(self, text: str, at: int) -> Tokens:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return Tokens(e.ids, spans[:, 0], spans[:, 1])

    def _leaf(self, text: str, at: int) -> Tokens:
        """Tokens of a short piece, word by word: none spans ASCII white space."""
        raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        space = np.ones(len(raw) + 2, dtype=bool)
        space[1:-1] = _SPACE[np.minimum(raw, 127)]
        change = np.flatnonzero(space[1:] != space[:-1])
        start = change[0::2]
        if not len(start):
            return Tokens([], [], [])
        if (change[1::2] - start).max() > MEMO_CHARS:
            return self._direct(text, at)
        which = self._numbers(text.encode().split())  # bytes.split() splits at ASCII white space
        lo = self.first[which]
        n = self.first[which + 1] - lo
        take = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        spans, base = self.spans[take], np.repeat(start + at, n)
        return Tokens(self.ids[take], base + (spans >> 16), base + (spans & 0xFFFF))

    def join(self, left: Tokens, right: Tokens, text: str, at: int, begin: int, middle: int, end: int) -> Tokens:
        """Tokens of code points ``begin`` to ``end``, from those on both sides of ``middle``.

        ``text`` holds the code points from ``at`` on.
        """
        if begin == middle or middle == end:
            return _concat((left, right))
        if _SPACE[min(ord(text[middle - at - 1]), 127)] or _SPACE[min(ord(text[middle - at]), 127)]:
            return _concat((left, right))  # no token spans ASCII white space
        width = self.window
        while True:
            lo = at + cut_before(text, max(begin, middle - width) - at, begin - at)
            hi = min(end, at + cut_after(text, min(end, middle + width) - at))
            inner = self._direct(text[lo - at : hi - at], lo)
            a = (0, 0) if lo == begin else _agreed(left, inner, lo, middle, last=True)
            b = (len(right), len(inner)) if hi == end else _agreed(right, inner, middle, hi, last=False)
            if a and b and a[1] <= b[1]:
                cut = lambda t, i, j: Tokens(t.ids[i:j], t.start[i:j], t.end[i:j])
                return _concat((cut(left, 0, a[0]), cut(inner, a[1], b[1]), cut(right, b[0], len(right))))
            width *= 2

    def tokens(self, text: str, at: int = 0) -> Tokens:
        """Tokens of ``text``, whose first code point has the position ``at``."""

        def tree(begin: int, end: int) -> Tokens:
            if end - begin <= self.leaf:
                return self._leaf(text[begin:end], at + begin)
            middle = cut_before(text, (begin + end) // 2, begin)
            if middle == begin:
                middle = cut_after(text, (begin + end) // 2)
            if middle >= end:
                return self._leaf(text[begin:end], at + begin)
            left, right = tree(begin, middle), tree(middle, end)
            return self.join(left, right, text, at, at + begin, at + middle, at + end)

        return tree(0, len(text))

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        if self.names is None:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False)
        names = self.names
        return " ".join([names[i] for i in ids])


def _agreed(side: Tokens, inner: Tokens, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
    """Token numbers in ``side`` and ``inner`` at a boundary that both have.

    The tokens before and after it are the same in both, and no token covers it. The
    one nearest to the join counts.
    """
    i, j = np.searchsorted(side.start, lo), np.searchsorted(side.start, hi)
    own = {}
    for k in range(int(i) + 1, int(j)):
        if side.end[k - 1] <= side.start[k]:
            own[side.start[k - 1], side.ids[k - 1], side.end[k - 1], side.start[k], side.ids[k], side.end[k]] = k
    order = range(len(inner) - 1, 0, -1) if last else range(1, len(inner))
    for k in order:
        key = inner.start[k - 1], inner.ids[k - 1], inner.end[k - 1], inner.start[k], inner.ids[k], inner.end[k]
        if key in own:
            return own[key], k
    return None


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder for each worker process."""
    return TreeEncoder(path, leaf)


_RESULT = "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def _numerals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _row(enc: TreeEncoder, ids: np.ndarray, with_ids: bool) -> dict:
    values = ids.tolist()
    numerals = _numerals(enc.tokenizer.get_vocab_size())
    listed = " ".join([numerals[i] for i in values])
    out = {
        "n_tokens": len(values),
        "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(enc.decode(values).encode()).hexdigest(),
    }
    return {"ids": ids} | out if with_ids else out


def _encoded(text: Column, path: str, schema: str) -> Column:
    with_ids = schema == _RESULT

    @F.pandas_udf(schema)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            rows = [_row(enc, enc.tokens(t if isinstance(t, str) else "").ids, with_ids) for t in batch]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        enc.rest()

    return encode(text)


def _long_texts(texts: DataFrame, path: str, schema: str) -> DataFrame:
    """``key`` and ``bpe`` of long texts, given as ``key`` and ``text``, by several tasks each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                at = 0
                while at < len(text):
                    end = cut_before(text, at + PART_CHARS, at)
                    if end == at:
                        end = cut_after(text, at + PART_CHARS)
                    yield pd.DataFrame({"key": [key], "at": [at], "part": [text[at:end]]})
                    at = end

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            for row in batch.itertuples():
                t = enc.tokens(row.part, row.at)
                yield pd.DataFrame([{"key": row.key, "at": row.at, "part": row.part, "ids": t.ids.tobytes(), "start": t.start.tobytes(), "end": t.end.tobytes()}])
        enc.rest()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path)
        group = group.sort_values("at")
        text = "".join(group["part"])
        nodes = [(r.at, r.at + len(r.part), Tokens(np.frombuffer(r.ids, np.int32), np.frombuffer(r.start, np.int64), np.frombuffer(r.end, np.int64))) for r in group.itertuples()]
        while len(nodes) > 1:
            pairs = zip(nodes[0::2], nodes[1::2], strict=False)
            joined = [(a, c, enc.join(x, y, text, 0, a, b, c)) for (a, b, x), (_, c, y) in pairs]
            nodes = joined + nodes[2 * len(joined) :]
        row = _row(enc, nodes[0][2].ids, schema == _RESULT)
        return pd.DataFrame([{"key": group["key"].iloc[0]} | row])

    parts = texts.mapInPandas(cut, "key string, at bigint, part string").repartition("key", "at")
    done = parts.mapInPandas(encode, "key string, at bigint, part string, ids binary, start binary, end binary")
    return done.groupBy("key").applyInPandas(merge, f"key string, {schema}")


def encode_texts(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    Columns of these names are replaced. A null text counts as empty: no ids, and the
    digests of the empty string. Repeated rows stay repeated. Equal long texts are
    encoded once.
    """
    schema = _RESULT if with_ids else _DIGESTS
    added = [c.split()[0] for c in schema.split(", ")]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    value = F.col(f"`{text}`")
    is_long = F.coalesce(F.length(value) > PART_CHARS, F.lit(False))
    short = docs.filter(~is_long).select(*own, _encoded(value, path, schema).alias("__bpe")).select(*own, "__bpe.*")
    long = docs.filter(is_long).select(*own, F.sha2(value, 256).alias("__key"))
    texts = long.select(F.col("__key").alias("key"), value.alias("text")).dropDuplicates(["key"])
    done = _long_texts(texts, path, schema).withColumnRenamed("key", "__key")
    return short.unionByName(long.join(done, "__key").select(*own, *added))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that token ids stand for; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([None if x is None else enc.decode(x) for x in batch], dtype=object)

    return docs.withColumn(into, decode(F.col(f"`{ids}`")))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the encoded and the decoded text of every document."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, default_path(), with_ids=False).drop("text")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids."""
    small_batches(spark)
    return encode_texts(docs, default_path())
