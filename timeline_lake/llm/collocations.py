"""Phrases whose words stand together more often than apart: exact counts of every frequent phrase, in bounded memory.

Words that occur often enough are counted first. Then, one length after the other, Misra-Gries summaries find a superset of
the frequent phrases: the hashes of a task's phrases are counted and dealt by hash partition, and each partition merges them
into one summary whose capacity exceeds the partition's mass divided by the threshold, so that no frequent phrase can be
lost. A phrase is only offered if its words, and both phrases one word shorter inside it, may be frequent. A last pass counts
what has survived exactly, by its text.

What a task must know about earlier rounds is a bitmap of hashes of fixed size (8 MB): hashes that share a bit are let
through, never lost, so a corpus with more phrases costs more work but changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage

LONGEST = 4
LEAST = 30
COVERED_PERCENT = 80
MOST = 2000
UNKNOWN = "und"
#: Bits of a bitmap, as a power of two.
BITMAP_BITS = 26
#: Entries that a summary should hold at most; the number of hash partitions follows from it.
CAPACITY = 1 << 18
MOST_PARTITION_BITS = 20
#: Sums that a task keeps before it gives them out.
HELD = 500_000
#: Words whose n-grams are counted together in a task, and bytes of text cut into words at once.
CHUNK_WORDS = 1 << 21
SLICE_BYTES = 1 << 21

# What ends a piece, and what separates words in it.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(_ENDS) + b" " + bytes(range(97, 123)))


class _Words(dict):
    """Numbers for the words of one language, given out on first sight."""

    def __init__(self, chunk: _Chunk, lang: str):
        super().__init__({b"": -1, b"\n": 0})
        self.chunk, self.lang = chunk, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.langs.append(self.lang)
        return number


class _Chunk:
    """Some texts as one array of word numbers; 0 stands between pieces. Numbers differ between languages."""

    def __init__(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.known: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.known.get(lang)
        if numbers is None:
            numbers = self.known[lang] = _Words(self, lang)
        words = text.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(words)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int32), *self.parts])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, the same ones as ``word_hash`` gives."""
        seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in self.known}
        of = xxhash.xxh64_intdigest
        return np.fromiter((of(w, seeds[s]) if s in seeds else 0 for w, s in zip(self.words, self.langs)), np.uint64, len(self.words))


class _Sums:
    """Counts per language and phrase of all chunks of a task, given out when there are many of them."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[bytes, int]] = {}
        self.size = 0

    def add(self, langs, phrases, counts) -> None:
        for lang, phrase, n in zip(langs, phrases, counts):
            known = self.counts.get(lang)
            if known is None:
                known = self.counts[lang] = {}
            if phrase in known:
                known[phrase] += n
            else:
                known[phrase] = n
                self.size += 1

    def batches(self, least: int = 0):
        """The sums so far as batches, one per language, if there are ``least`` of them at least."""
        if self.size and self.size >= least:
            for lang, known in self.counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(known), pa.string()), pa.array(known.keys(), pa.binary()), pa.array(known.values(), pa.int64())], ["lang", "phrase", "a"]
                )
            self.__init__()


def word_hash(lang: str, word: str) -> Column:
    return F.xxhash64(F.col(lang), F.col(word))


def _slices(text: bytes):
    """A text with its pieces ended by line feeds, in parts of about a slice that end where a piece does."""
    text, at = text.translate(_NORMAL), 0
    while len(text) - at > SLICE_BYTES:
        end = text.find(b"\n", at + SLICE_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _chunks(batches, size: int):
    chunk = _Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _slices(text.as_py()):
                chunk.add(lang, part)
                if chunk.size >= size:
                    yield chunk
                    chunk = _Chunk()
    if chunk.size:
        yield chunk


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all but its last word and of its last word."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + b
        z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ z >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ z >> np.uint64(32)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _offered(chunk: _Chunk, bitmaps: list[np.ndarray]):
    """For each length from 2 to one more than there are bitmaps: starts of the phrases that may be frequent, their hashes.

    ``bitmaps`` are those of one word, two words and so on. The last length has no bitmap: all its phrases whose parts are
    marked are offered.
    """
    ids, words = chunk.ids(), chunk.hashes()
    flags = _marked(bitmaps[0], words)
    flags[0] = False
    good = flags[ids]
    word_hashes = words[ids]
    at_hash = word_hashes
    for n in range(2, len(bitmaps) + 2):
        starts = np.flatnonzero(good[:-1] & good[1:])
        hashes = mixed(at_hash[starts], word_hashes[starts + n - 1])
        yield n, ids, starts, hashes
        if n <= len(bitmaps):
            kept = _marked(bitmaps[n - 1], hashes)
            good = np.zeros(len(ids), bool)
            good[starts[kept]] = True
            at_hash = np.zeros(len(ids), np.uint64)
            at_hash[starts] = hashes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    )


def count_words(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, phrase, a: the occurrences of every word; each task adds up its own first."""

    def count(batches):
        sums = _Sums()
        for chunk in _chunks(batches, chunk_words):
            sums.add(chunk.langs[1:], chunk.words[1:], np.bincount(chunk.ids(), minlength=len(chunk.words))[1:].tolist())
            yield from sums.batches(HELD)
        yield from sums.batches()

    return _summed(_texts(docs).mapInArrow(count, "lang string, phrase binary, a long"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a"))


class MisraGries:
    """A mergeable summary of weighted 64-bit keys.

    With more than ``capacity`` keys, the count after the ``capacity``-th largest is taken off all of them and keys without
    a rest go. What is taken off in all, ``error``, is at most the mass divided by ``capacity`` + 1; a key's true count
    lies between its rest and its rest plus ``error``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error, self.waiting = capacity, 0, 0
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self.waiting = 0
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            if len(keys) > self.capacity:
                cut = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
                self.error += int(cut)
                keys, counts = keys[counts > cut], counts[counts > cut] - cut
            self.keys, self.counts = [keys], [counts]
        return self.keys[0], self.counts[0]

    def possible(self, least: int) -> np.ndarray:
        """Keys that may occur ``least`` times or more."""
        keys, counts = self.settle()
        return keys[counts + self.error >= least]


def _summaries(docs: DataFrame, shared, least: int, partition_bits: int, chunk_words: int) -> DataFrame:
    """slot, bits: the bitmap of hashes of phrases, one word longer than the last of ``shared``, that may be frequent."""

    def offer(batches):
        for chunk in _chunks(batches, chunk_words):
            *_, (_, _, _, hashes) = _offered(chunk, shared.value)
            keys, counts = np.unique(hashes, return_counts=True)
            home = (keys >> np.uint64(64 - partition_bits)).astype(np.int64) if partition_bits else np.zeros(len(keys), np.int64)
            first = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(keys) else []
            ends = [*first[1:], len(keys)] if len(keys) else []
            rows = []
            for a, b in zip(first, ends):
                # The masses of a hash partition come before its phrases.
                rows.append((int(home[a]), 0, int(counts[a:b].sum()), b"", b""))
                rows.append((int(home[a]), 1, 0, keys[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u4").tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["home", "kind", "mass", "keys", "counts"])

    def merge(batches):
        home, mass, summary = None, 0, None

        def bits():
            at = np.unique(summary.possible(least) >> np.uint64(64 - BITMAP_BITS))
            slots = at >> np.uint64(6)
            first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(at) else np.zeros(0, np.int64)
            words = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            return pa.RecordBatch.from_arrays([pa.array(slots[first].astype(np.int64)), pa.array(words.view(np.int64))], ["slot", "bits"])

        for batch in batches:
            for h, kind, m, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if h != home:
                    if summary is not None:
                        yield bits()
                    home, mass, summary = h, 0, None
                if kind == 0:
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass // least + 1)
                summary.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64))
        if summary is not None:
            yield bits()

    packets = _texts(docs).mapInArrow(offer, "home long, kind int, mass long, keys binary, counts binary")
    dealt = packets.repartition("home").sortWithinPartitions("home", "kind")
    return dealt.mapInArrow(merge, "slot long, bits long")


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A bitmap on the driver, from at most 2^(BITMAP_BITS - 6) rows of 64 bits each."""
    table = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    bitmap[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _word_bits(words: DataFrame) -> DataFrame:
    """slot, bits: one set bit per word."""
    at = words.select(F.shiftrightunsigned(word_hash("lang", "phrase"), 64 - BITMAP_BITS).alias("at"))
    return at.select(F.shiftrightunsigned("at", 6).alias("slot"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))


def _count_survivors(docs: DataFrame, shared, chunk_words: int) -> DataFrame:
    """lang, phrase, length, a: exact counts of the phrases whose hashes are marked, added up by text."""

    def count(batches):
        bitmaps, sums = shared.value, _Sums()
        for chunk in _chunks(batches, chunk_words):
            numbers = None
            for n, ids, starts, hashes in _offered(chunk, bitmaps[:-1]):
                kept = starts[_marked(bitmaps[n - 1], hashes)]
                if not len(kept):
                    break
                # A phrase is numbered by the number of all but its last word and by its last word, so equal numbers are equal phrases.
                left = ids[kept].astype(np.int64) if n == 2 else numbers[kept]
                _, first, inverse, times = np.unique(
                    left * len(chunk.words) + ids[kept + n - 1], return_index=True, return_inverse=True, return_counts=True
                )
                numbers = np.zeros(len(ids), np.int64)
                numbers[kept] = inverse
                found = [ids[at : at + n].tolist() for at in kept[first].tolist()]
                sums.add((chunk.langs[p[0]] for p in found), (b" ".join([chunk.words[w] for w in p]) for p in found), times.tolist())
                yield from sums.batches(HELD)
        yield from sums.batches()

    counts = _summed(_texts(docs).mapInArrow(count, "lang string, phrase binary, a long"))
    return counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("length"), "a")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, capacity: int = CAPACITY, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, a) of every phrase of 1 to ``longest`` words with a >= ``least``; (lang, n) of every language.

    Counts are exact. Phrases are words of one piece of a text joined by a space, overlapping occurrences count, and A to Z
    count as a to z. A null language is ``und``, a null text has no words. Both results are written tables.
    """
    spark = docs.sparkSession
    totals = cut_lineage(
        count_words(docs, chunk_words)
        .withColumn("often", F.col("a") >= least)
        .groupBy("lang", F.when(F.col("often"), F.col("phrase")).alias("phrase"))
        .agg(F.sum("a").alias("a"), F.first("often").alias("often"))
    )
    sizes = totals.groupBy("lang").agg(F.sum("a").alias("n"))
    words = totals.filter("often").select("lang", "phrase", F.lit(1).alias("length"), "a")
    mass = totals.agg(F.sum("a")).first()[0] or 0
    partition_bits = min(MOST_PARTITION_BITS, max(0, int(np.ceil(np.log2(max(1, mass / (capacity * least)))))))
    bitmaps = [_bitmap(_word_bits(words))]
    for _ in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(bitmaps)
        bitmaps = [*bitmaps, _bitmap(_summaries(docs, shared, least, partition_bits, chunk_words))]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(bitmaps)
    phrases = cut_lineage(_count_survivors(docs, shared, chunk_words).filter(F.col("a") >= least))
    shared.unpersist()
    return words.unionByName(phrases), sizes


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered_percent: int = COVERED_PERCENT, most: int = MOST, capacity: int = CAPACITY,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """The best phrases of each language of ``docs`` (lang, text, …): lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut into two parts that occur l and r times; its
    score is 2,000,000 a / (l + r), rounded down, at its worst cut (the shortest first part of equal ones). A phrase goes if a
    longer candidate around it occurs at least ``covered_percent`` per cent as often. The first ``most`` by score, a (both
    falling) and phrase stay, so ranks have no ties. ``n`` is the number of words of the language. An empty table gives none.
    """
    counts, sizes = frequent_phrases(docs, least, longest, capacity, chunk_words)
    found = counts.filter("length > 1").withColumn("words", F.split("phrase", " "))
    parts = found.select("lang", "phrase", "a", "length", "words", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    parts = parts.select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, length), ' ')").alias("rest")
    )
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = parts.join(known.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(known.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(38, 0)) * a) div (cast(l as decimal(20, 0)) + r)")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    inner = (
        found.filter("length > 2")
        .select("lang", F.col("a").alias("around"), "length", "words", F.explode(F.expr("sequence(2, length - 1)")).alias("size"))
        .select("lang", "around", F.explode(F.expr("transform(sequence(1, length - size + 1), i -> array_join(slice(words, i, size), ' '))")).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("around").alias("around"))
    )
    covered = F.expr(f"around is not null and cast(100 as decimal(38, 0)) * around >= {int(covered_percent)} * cast(a as decimal(20, 0))")
    left = worst.join(inner, ["lang", "phrase"], "left").filter(~covered)
    ranked = left.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    )
    best = ranked.filter(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(given(spark, folder, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT lang, a AS around, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM (SELECT *, unnest(range(2, k)) AS size FROM cand)),
covered AS (SELECT lang, phrase, max(around) AS around FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst w LEFT JOIN covered c USING (lang, phrase) WHERE c.around IS NULL OR 100 * c.around < 80 * w.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
