"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string the last token of its encoding is unique. It is the one token that ends the prefix, and
may follow the last token of the shorter prefix before it: two tokens may stand side by side if their bytes together
encode to just these two. Storing one token per prefix therefore holds the encodings of all prefixes; appending goes on
from the last entry, and after an edit only the entries near it change.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.llm.tokens import WordCache, vocabulary

RANKS_FILE = "byte_bpe_50k.tiktoken"
MEMO_PAIRS = 500_000


class PrefixBpe:
    """The merges of a rank file, seen as which token may end which prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        # Every token with its length and what is known about the tokens that may stand before it.
        self.suffixes = ahocorasick.Automaton()
        self.before: list[dict[int, bool]] = [{} for _ in self.bytes_of]
        self.n_pairs = 0
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.suffixes.add_word(token.decode("latin-1"), (len(token), rank, self.before[rank]))
        self.suffixes.make_automaton()
        self.longest = max(map(len, ranks))

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first, of a string of at most two tokens' length."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.bytes_of)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, before: int, token: int) -> bool:
        if self.n_pairs >= MEMO_PAIRS:
            for known in self.before:
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        valid = self.before[token][before] = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return valid

    def extend(self, data: bytes, last: list[int], to: int | None = None) -> None:
        """Add the last tokens of the prefixes of ``data`` that ``last`` does not hold yet, up to length ``to``."""
        to = len(data) if to is None else to
        have = len(last)
        base = max(0, have - self.longest)
        # Tokens that end at each byte, longest first. Every byte is a token, so none is passed over.
        for at, (n, token, allowed) in self.suffixes.iter(data[base:to].decode("latin-1")):
            end = base + at + 1
            if end <= have:
                continue
            if end > have + 1:
                break
            if n < end:
                before = last[end - n - 1]
                valid = allowed.get(before)
                if not (self.may_follow(before, token) if valid is None else valid):
                    continue
            last.append(token)
            have = end
        if have != to:
            raise ValueError(f"no token may end at byte {have}")

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece (one match of the splitting pattern)."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.tokens(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTokens:
    """One byte string with the last token of each of its prefixes. Appends and edits keep it exact."""

    def __init__(self, model: PrefixBpe, data: bytes = b""):
        self.model, self.data, self.last = model, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.model.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of ``data[start:end]``. Returns how many entries had to be worked out.

        An entry depends only on the bytes and entries of the longest token's length before it. Once that many entries
        behind the edit come out as they were, so do all that follow.
        """
        old = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        edited = start + len(new)
        step = self.model.longest
        self.model.extend(self.data, self.last, edited)
        for at in range(0, len(old), step):
            self.model.extend(self.data, self.last, min(edited + at + step, len(self.data)))
            if at and self.last[edited + at :] == old[at : at + step]:
                worked_out = len(self.last) - start
                self.last += old[at + step :]
                return worked_out
        return len(self.last) - start

    def tokens(self) -> list[int]:
        return self.model.tokens(self.last)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it; Python's own class holds four control characters more."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class TextEncoder:
    """Whole texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str):
        self.model, self.split = PrefixBpe(read_ranks(ranks_path)), splitter(pattern)
        self.decimals = [str(i) for i in range(len(self.model.bytes_of))]
        self.cache = WordCache(self._word, self._pieces)

    def _word(self, text: str) -> bytes:
        return array("I", self.model.encode(text.encode("utf-8"))).tobytes()

    def _pieces(self, text: str) -> bytes:
        ids: list[int] = []
        encode = self.model.encode
        for piece in self.split.findall(text):
            ids += encode(piece.encode("utf-8"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cache.encode(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.model.decode(ids.tolist())


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int, in order) for every row; a null or empty text has no ids."""

    def rows(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            for ids, texts in _small(batch):
                found = [encoder.encode(t or "") for t in texts.to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = pa.array(np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes for every row of ids; null ids count as none."""

    def rows(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            for doc_ids, lists in _small(batch):
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array([encoder.decode(np.array(x or [], "<u4")) for x in lists.to_pylist()], pa.binary())], ["doc_id", "bytes"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def _small(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), part.column(1)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                plain = ids.tolist()
                back = encoder.model.decode(plain)
                out.append((len(plain), hashlib.sha256(" ".join(map(encoder.decimals.__getitem__, plain)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, b = list(zip(*out)) or ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_prefix(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(given(spark, folder, "documents"), vocabulary(RANKS_FILE), public_tokenizers.PATTERN)
