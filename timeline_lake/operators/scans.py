"""Rules that carry one number from row to row, worked out without a walk through a whole key.

A row is a step function of that number: ``pieces``, an array of (upto, to) in rising order of ``upto``, maps a number to
the ``to`` of the first piece with ``upto`` >= it and leaves it alone beyond the last one; "no number yet" counts as less
than any. Such functions compose to functions of the same kind, so those of a block of rows become one, blocks become rows
of the next level, and what comes out at the top is handed down again. Every array holds one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeline_lake.session import cut_lineage

FANOUT = 64
PIECES = "array<struct<upto:double,to:double>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stepped(pieces: Column, x: Column) -> Column:
    """The function's value at ``x`` (null: no number yet)."""
    fit = F.filter(pieces, lambda p: x.isNull() | (p["upto"] >= x))
    return F.coalesce(F.get(fit, F.lit(0))["to"], x)


def composed(first: Column, second: Column) -> Column:
    """Pieces of "``first``, then ``second``". Neighbours that lead to the same number are one piece."""
    through = F.transform(first, lambda p: F.struct(p["upto"].alias("upto"), stepped(second, p["to"]).alias("to")))
    top = F.get(first, F.size(first) - 1)["upto"]
    beyond = F.filter(second, lambda p: top.isNull() | (p["upto"] > top))

    def merged(all_: Column) -> Column:
        return F.filter(all_, lambda p, i: (i == F.size(all_) - 1) | ~F.get(all_, i + 1)["to"].eqNullSafe(p["to"]))

    return _let(F.concat(through, beyond), merged)


def values_before(df: DataFrame, keys: list[str], index: str, pieces: str, fanout: int = FANOUT) -> DataFrame:
    """keys, ``index``, _before: the number each row is given, which starts as null for every key.

    ``index`` (0 or more, holes allowed) orders a key's rows and ``df`` should be a written table: its largest index is asked
    for, and says how many levels there are (log of it to the base ``fanout``).
    """
    top = df.agg(F.max(index)).first()[0]
    rows = df.select(F.struct(*keys).alias("_key"), F.col(index).cast("long").alias("_i"), F.col(pieces).cast(PIECES).alias("_f"))
    found = _before(rows, top or 0, fanout)
    return found.select("_key.*", F.col("_i").alias(index), "_before")


def _before(rows: DataFrame, top: int, fanout: int) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("_i", "_f"))).alias("_list")
    if top < fanout:
        blocks = rows.groupBy("_key").agg(listed).withColumn("_start", F.lit(None).cast("double"))
    else:
        block = F.floor(F.col("_i") / F.lit(fanout)).cast("long")
        blocks = cut_lineage(rows.groupBy("_key", block.alias("_block")).agg(listed))
        none = F.array().cast(PIECES)
        whole = F.aggregate("_list", none, lambda f, row: composed(f, row["_f"]))
        starts = _before(blocks.select("_key", F.col("_block").alias("_i"), whole.alias("_f")), top // fanout, fanout)
        blocks = blocks.join(starts.select("_key", F.col("_i").alias("_block"), F.col("_before").alias("_start")), ["_key", "_block"])
    none = F.array().cast("array<struct<i:bigint,before:double>>")

    def walk(state: Column, row: Column) -> Column:
        note = F.struct(row["_i"].alias("i"), state["x"].alias("before"))
        return F.struct(stepped(row["_f"], state["x"]).alias("x"), F.concat(state["out"], F.array(note)).alias("out"))

    out = F.aggregate("_list", F.struct(F.col("_start").alias("x"), none.alias("out")), walk)["out"]
    return blocks.select("_key", F.inline(out).alias("_i", "_before"))
