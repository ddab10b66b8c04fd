"""Token ids of whole texts, with each distinct word encoded once per worker.

Byte-level BPE never merges across the matches of its splitting pattern, and that pattern always begins a new match at a
space that a non-space character follows. Texts are cut there, so the ids of a text are the ids of its cuts in order.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE_JSON = "byte_bpe_50k.json"
SEGMENT_CHARS = 1 << 20
CACHE_WORDS = 400_000
BATCH_CACHE_WORDS = 250_000
CHUNK_BYTES = 4 << 20
JOINED_CHARS = 1 << 16
KEPT_CHARS = 64
MARKS = ".,;:!?|\n"

_BOUNDARY = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
#: Begins a piece that no space stands before.
GLUE = "\x01"
_LATIN = r"\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
# A run of ASCII marks between a letter and a space or line end; a line end between something visible and a letter.
_MARKED = rf"([A-Za-z{_LATIN}])([!-/:-@\[-`{{-~]+)([ \n])", rf"\1 {GLUE}\2\3"
_LINE_END = rf"([!-~{_LATIN}])\n([A-Za-z{_LATIN}])", f"\\1 {GLUE}\n {GLUE}\\2"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, as seen by the process that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a long text at safe places into parts of about ``size`` characters. All but the first begin with a space."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class WordCache:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``word`` encodes one run of letters, with or without a space before it; ``whole`` any text. The cuts met last are kept
    in two generations of about ``limit`` each: a full one becomes the older, and what is met again moves to the newer.
    """

    def __init__(self, word: Callable[[str], bytes], whole: Callable[[str], bytes], limit: int = CACHE_WORDS):
        self.word, self.whole, self.limit = word, whole, limit
        self.marks = {m: whole(m) for m in MARKS}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return b"".join(self._segment(part) for part in segments(text) if part)

    def _segment(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        head = self.whole(first) if first else b""
        met = set(rest)
        unknown = met.difference(self.new)
        if unknown:
            if len(self.new) + len(unknown) > self.limit:
                self.old, self.new = self.new, {}
                unknown = met
            new, old = self.new, self.old
            for cut in unknown:
                new[cut] = old[cut] if cut in old else self._cut(cut)
        return head + b"".join(map(self.new.__getitem__, rest))

    def _cut(self, cut: str) -> bytes:
        """A cut without its space: a word, perhaps with a mark after it, perhaps with one more such word in the next line."""
        if letters(cut):
            return self.word(" " + cut)
        if cut[-1] in self.marks and letters(base := cut[:-1]):
            return self._known(base) + self.marks[cut[-1]]
        before, line, after = cut.partition("\n")
        mark = self.marks.get(after[-1:], b"")
        if line and before and letters(after[:-1] if mark else after) and (letters(before) or before[-1] in self.marks and letters(before[:-1])):
            left = self._known(before) if letters(before) else self._known(before[:-1]) + self.marks[before[-1]]
            return left + self.marks["\n"] + self.word(after[:-1] if mark else after) + mark
        return self.whole(" " + cut)

    def _known(self, word: str) -> bytes:
        ids = self.new.get(word) or self.old.get(word)
        if ids is None:
            ids = self.new[word] = self.word(" " + word)
        return ids


def letters(text: str) -> bool:
    """Whether a text is one run of letters of long-standing scripts, which every version of Unicode classes alike."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0500")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the 256 bytes: printable Latin-1 characters as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class BatchEncoder:
    """Ids of many texts at once by the tokenizers library, special tokens as plain text.

    Arrow cuts the texts of a chunk at their spaces, and words from marks and line ends that follow them; each of these begins a
    match of the splitting pattern. What no space stands before begins with ``GLUE``. The distinct pieces are numbered by Arrow, so
    Python sees each once. A run of letters is one match, so the library's model is asked for it directly. Other pieces go to the
    library joined in one text: a piece holds no space but the one before it, so its ids are those from one token that begins with a
    space up to the next. A text in which white space follows a space, or that ends with one, goes there as it is. What was asked is
    kept in two generations of about ``limit`` each, as in :class:`WordCache`; long pieces are not kept.
    """

    def __init__(self, path: str, limit: int = BATCH_CACHE_WORDS, chunk_bytes: int = CHUNK_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.spelled = self.tokenizer.model.tokenize, byte_letters()
        self.limit, self.chunk_bytes = limit, chunk_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(self.spelled[0x20])]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self._chunk(pa.array([text], pa.large_string()))[0].tobytes()

    def chunks(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of the next texts, null ones as empty, ``end_id`` after each."""
        texts = pc.fill_null(texts, "")
        before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(before, before[at] + self.chunk_bytes, side="right")) - 1)
            ids, sizes = self._chunk(texts.slice(at, to - at).cast(pa.large_string()))
            yield np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            at = to

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(texts, *_MARKED)
        cut = pc.replace_substring_regex(cut, *_LINE_END)
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(GLUE, pa.large_string()), cut, pa.scalar("", pa.large_string())), " ")
        borders = lists.offsets.to_numpy()
        distinct = pc.dictionary_encode(lists.values)
        codes = distinct.indices.to_numpy().copy()
        found, odd = self._pieces(distinct.dictionary.to_pylist())
        whole = pc.match_substring(texts, GLUE).to_numpy(zero_copy_only=False)
        if odd:
            hit = np.zeros(len(found), bool)
            hit[odd] = True
            whole = whole | (np.add.reduceat(hit[codes].astype(np.int64), borders[:-1]) > 0)
        if whole.any():
            nothing = len(found)
            found.append(b"")
            for i in np.flatnonzero(whole).tolist():
                codes[borders[i] + 1 : borders[i + 1]] = nothing
                codes[borders[i]] = len(found)
                found.append(self._whole(texts[i].as_py()))
        table = np.frombuffer(b"".join(found), "<u4")
        # A text has fewer than 2^31 bytes, so 32 bits hold every place in a chunk.
        lengths = (np.fromiter(map(len, found), np.int64, len(found)) // 4).astype(np.int32)
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        taken = lengths[codes]
        ends = np.cumsum(taken, dtype=np.int32)
        ids = table[np.repeat(starts[codes] - ends + taken, taken) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.add.reduceat(taken, borders[:-1], dtype=np.int64)

    def _whole(self, text: str) -> bytes:
        return b"".join(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes() for part in segments(text) if part)

    def _pieces(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct pieces; and the places of those that may belong to the space before them, left empty."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        odd: list[int] = []
        others: list[int] = []
        size = 0
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            piece = pieces[i]
            glued = piece[:1] == GLUE
            text = piece[1:] if glued else piece
            if (ids := self.old.get(piece)) is not None:
                self.new[piece] = ids
            elif letters(text):
                ids = self._word(text if glued else " " + text)
            elif glued:
                ids = self._whole(text)
            elif not text or text[0].isspace():
                odd.append(i)
                found[i] = b""
                continue
            else:
                others.append(i)
                size += len(text)
                if size > JOINED_CHARS:
                    self._joined(pieces, others, found)
                    others, size = [], 0
                continue
            found[i] = ids
            if len(piece) <= KEPT_CHARS:
                self.new[piece] = ids
        if others:
            self._joined(pieces, others, found)
        return found, odd

    def _word(self, text: str) -> bytes:
        """Ids of a run of letters, perhaps with a space before it."""
        text = text.replace(" ", self.spelled[0x20]) if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self.spelled)
        return array("I", [token.id for token in self.merge(text)]).tobytes()

    def _joined(self, pieces: list[str], places: list[int], found: list[bytes | None]) -> None:
        asked = [pieces[i] for i in places]
        ids = np.array(self.tokenizer.encode(" " + " ".join(asked), add_special_tokens=False).ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(asked):
            raise ValueError("a token of this vocabulary holds a space that is not its first character")
        flat = ids.tobytes()
        borders = (4 * starts).tolist()
        for i, piece, a, b in zip(places, asked, borders, [*borders[1:], len(flat)]):
            found[i] = flat[a:b]
            if len(piece) <= KEPT_CHARS:
                self.new[piece] = found[i]


_ENCODERS: dict[str, BatchEncoder] = {}


def tokenizer_cache(path: str) -> BatchEncoder:
    """The encoder of this Python worker for a vocabulary file of the tokenizers library; special tokens are plain text."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]
