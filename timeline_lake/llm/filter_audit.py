"""How filters act on each other: what each of them removes in every order, split by part of the corpus.

Four filters look at one text. The fifth, "its text stands under a smaller id", needs the whole table. A counting Bloom sketch
clears most texts of it without moving them: every row raises a few counters of the block its hash names, tasks add up their
own before the counters are merged, and a text with a counter at one is alone. Only the others are read again and sent,
whole, to be grouped by their bytes. Then each row is one mask of failed filters, and everything asked for is a sum over
counts per (part, mask), at most 32 rows a part, however many rows the corpus has.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Counters of one block (the bits of a long), how many of them a row raises, and rows a block is made for.
BLOCK_COUNTERS = 64
RAISED = 4
ROWS_PER_BLOCK = 4

# The white space between words, and the symbols of filter D.
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: filters A to D fail. A text without words fails A only (and C or D by its characters)."""
    trimmed = F.btrim(text, F.lit(_WHITE))
    words = F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")
    # Splitting a text without words gives one empty word.
    none = (trimmed == "").cast("int")
    n, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text), text.rlike(_SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def _block(blocks: int) -> Column:
    return F.pmod(F.col("_hash"), F.lit(blocks))


def _counters() -> list[Column]:
    """Places of a row's counters in its block. They come from another hash than the block does."""
    other = F.xxhash64("_hash")
    bits = BLOCK_COUNTERS.bit_length() - 1
    return [F.shiftrightunsigned(other, bits * i).bitwiseAND(F.lit(BLOCK_COUNTERS - 1)).cast("int") for i in range(RAISED)]


def _row_bits() -> Column:
    bits = F.lit(0).cast("long")
    for place in _counters():
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def shared_counters(hashes: DataFrame, blocks: int) -> DataFrame:
    """The merged sketch of ``_hash``: _block, _raised, the counters that were raised by two rows or more, as bits.

    A row raises a counter once, even if two of its places are equal, so one row alone never takes a counter to two.
    """
    places = hashes.select(_block(blocks).alias("_block"), F.explode(F.array_distinct(F.array(*_counters()))).alias("_place"))
    counters = places.groupBy("_block", "_place").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counters.groupBy("_block").agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_raised"))


def possible_repeats(hashes: DataFrame) -> DataFrame:
    """Distinct ``_hash`` values that may occur more than once: no value that does is missing."""
    blocks = max(1, hashes.count() // ROWS_PER_BLOCK)
    sketch = shared_counters(hashes, blocks)
    seen = hashes.select("_hash", _block(blocks).alias("_block"), _row_bits().alias("_bits"))
    return seen.join(sketch, "_block").filter(F.col("_raised").bitwiseAND(F.col("_bits")) == F.col("_bits")).select("_hash").distinct()


def repeated_rows(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _hash, …) with ``_repeated``: whether a row with a smaller doc_id has the same text.

    ``texts`` are the same rows with their ``_text``, which are read again. A null doc_id is neither smaller nor larger than
    another.
    """
    asked = cut_lineage(possible_repeats(rows))
    variants = texts.join(asked, "_hash", "left_semi").groupBy("_hash", "_text").agg(F.min("doc_id").alias("_least"))
    by_hash = cut_lineage(variants.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts"), F.min("_least").alias("_least")))
    repeated = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)).alias("_repeated")
    clashing = by_hash.filter("_texts > 1").select("_hash")
    if clashing.isEmpty():
        return rows.join(by_hash, "_hash", "left").select(*rows.columns, repeated)
    # Rows find the least id of their text by its hash; where a hash stands for two texts, by the text itself.
    plain = rows.join(clashing, "_hash", "left_anti").join(by_hash, "_hash", "left").select(*rows.columns, repeated)
    met = texts.join(clashing, "_hash", "left_semi")
    exact = met.join(met.groupBy("_hash", "_text").agg(F.min("doc_id").alias("_least")), ["_hash", "_text"])
    return plain.unionByName(exact.select(*rows.columns, repeated))


def mask_counts(docs: DataFrame, labels: DataFrame, digest=F.xxhash64) -> DataFrame:
    """part, mask, n, good, toxic: rows of ``docs`` (doc_id, text, lang) by part and failed filters, and labelled ones of them.

    A part is a value of ``lang``, null as the empty string; a null text is empty. A document is good (toxic) if any of its
    label rows says so; label rows without an id count for none. Every row counts, repeated ones as well.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    texts = texts.withColumn("_hash", digest("_text")).withColumn("_mask", text_mask(F.col("_text")))
    flagged = repeated_rows(cut_lineage(texts.drop("_text")), texts)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    mask = F.col("_mask") + F.when(F.col("_repeated"), REPEATED).otherwise(0)
    joined = flagged.select("doc_id", "part", mask.cast("int").alias("mask")).join(marks.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    sums = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]]
    return joined.groupBy("part", "mask").agg(*sums)


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from additive counts per (part, mask).

    kept: passes all filters up to this step; removed: fails this one first; redundant: fails it after an earlier one;
    unique_fails: fails nothing else; good_lost, toxic_lost: labelled ones of the removed; shapley: what the filter removes,
    summed over all orders — a mask with m filters is removed by each of them in one of m orders.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, i + 1, bit[o[i]], sum(bit[f] for f in o[:i])) for o in orders for i in range(len(o))]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for o, s, f, b in steps])
    each = counts.withColumn("_step", F.explode(table)).select("part", "mask", "n", "good", "toxic", "_step.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when: Column, value: str = "n") -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")

    share = F.expr(f"n * cast({len(orders)} div bit_count(mask) as bigint)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(mask_counts(given(spark, folder, "documents"), given(spark, folder, "labels")))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
least_ids AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
figures AS (
  SELECT d.doc_id, part, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w, length(d.t) AS chars,
         length(regexp_replace(d.t, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(d.t, '[#$%&*|]') AS symbol,
         coalesce(d.doc_id > l.least, false) AS repeated
  FROM docs d JOIN least_ids l USING (t)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * capitals > 10 * chars)::INT
         + 8 * symbol::INT + 16 * repeated::INT AS mask
  FROM figures LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step::INTEGER AS step, (1 << (ascii(filter_order[step:step]) - 65))::INT AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i:i]) - 65))), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step,
       sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps GROUP BY ALL
"""
