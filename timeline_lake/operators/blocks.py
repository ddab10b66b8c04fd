"""Ordered operators that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. One recording, spec or user may hold a
third of all rows, so here each key's ordered rows are cut into blocks of bounded size and windows run per
(key, block). What has to cross a block border travels in one of two ways:

* a fixed reach (previous / next ``n`` rows) by sending the border rows to the neighbouring block as well (``halo``);
* an unbounded reach (running sums, last known value) by one summary row per block, a window over those
  summaries, and a join back. Summaries are ``block`` times fewer than rows, and aggregate on the map side.

The second way reads its input twice and sends its rows by (key, block). Where :func:`fits` has found no key longer than a block,
``block`` is given as None: windows then run per key, one after the other on rows that are sent once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18
KEY_HASHES = 1 << 16
BLOCK = "_block"
SLOT = "_slot"
CORE = "_core"


def block_of(index: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(index) / F.lit(rows)).cast("long")


def fits(df: DataFrame, keys: list[str], rows: int = BLOCK_ROWS) -> bool:
    """Whether every key is sure to have ``rows`` rows or fewer.

    Rows are counted per hash of the key, at most KEY_HASHES counts a task, first by the leading key alone: a count is never less
    than that of a key in it, so keys too long are never passed, and few columns are read. Keys that share a hash may be refused
    together; the blocks that are then used give the same.
    """
    for some in (keys[:1], keys) if len(keys) > 1 else (keys,):
        counted = df.groupBy(F.pmod(F.xxhash64(*some), F.lit(KEY_HASHES)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
        if (counted.agg(F.max("_n")).first()[0] or 0) <= rows:
            return True
    return False


def halo(df: DataFrame, index: str, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and repeat rows near a border in the block that has to look at them.

    ``index`` must number a key's rows 0, 1, 2, … without holes, as word, scene and segment indexes do.
    Windows over (key, ``_block``) then see ``before`` rows back and ``after`` rows ahead of every row whose
    ``_core`` is true; drop the others afterwards with :func:`core_rows`.
    """
    if rows < max(before, after, 1):
        raise ValueError("a block must be at least as long as its halo")
    own = block_of(index, rows)
    offset = F.pmod(F.col(index), F.lit(rows))
    homes = [own]
    if before:
        homes.append(F.when(offset >= rows - before, own + 1))
    if after:
        homes.append(F.when((offset < after) & (own > 0), own - 1))
    if len(homes) == 1:
        return df.withColumn(BLOCK, own).withColumn(CORE, F.lit(True))
    return df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*homes)))).withColumn(CORE, F.col(BLOCK) == own)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(CORE).drop(CORE)


def block_window(keys: list[str], order: str | list[str]):
    names = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys, BLOCK).orderBy(*names)


def _slotted(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Add ``_slot``: a row's keys and block as one struct, which is never null, so rows with null keys meet as well."""
    return df.withColumn(SLOT, F.struct(*[F.col(k) for k in keys], block.alias(BLOCK)))


def _slot_window(order: str | list[str]):
    return Window.partitionBy(SLOT).orderBy(*([order] if isinstance(order, str) else order))


def _neighbours(keys: list[str], start: int, end: int):
    """Window over the summaries of a key's blocks."""
    return Window.partitionBy(*[f"{SLOT}.{k}" for k in keys]).orderBy(f"{SLOT}.{BLOCK}").rowsBetween(start, end)


def running(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    values: dict[str, Column],
    block: Column | None,
    agg: Callable[[Column], Column] = F.sum,
    keep_slot: bool = False,
) -> DataFrame:
    """Add one column per entry of ``values``: ``agg`` (sum, max, min) over the key's earlier rows; null if there are none.

    With ``keep_slot`` the column the rows are dealt by stays, so that a later window within it needs no exchange.
    """
    if block is None:
        along = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
        summed = df.withColumns({n: agg(c).over(along) for n, c in values.items()})
        return summed.withColumn(SLOT, F.struct(*keys)) if keep_slot else summed
    blocked = _slotted(df, keys, block)
    totals = blocked.groupBy(SLOT).agg(*[agg(c).alias(f"_t_{n}") for n, c in values.items()])
    earlier = _neighbours(keys, Window.unboundedPreceding, -1)
    carried = totals.select(SLOT, *[agg(F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n in values])
    inside = _slot_window(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(carried, SLOT)
    for name, value in values.items():
        here, before = agg(value).over(inside), F.col(f"_c_{name}")
        joined = joined.withColumn(f"_i_{name}", here)
        here = F.col(f"_i_{name}")
        if agg is F.sum:
            both = before + here
        else:
            both = (F.greatest if agg is F.max else F.least)(before, here)
        joined = joined.withColumn(name, F.coalesce(both, before, here))
    return joined.drop(*([] if keep_slot else [SLOT]), *[f"_c_{n}" for n in values], *[f"_i_{n}" for n in values])


def running_sums(
    df: DataFrame, keys: list[str], order: str | list[str], sums: dict[str, Column], block: Column | None, keep_slot: bool = False
) -> DataFrame:
    """Totals over the key's earlier rows, this row not included; 0 for the first."""
    summed = running(df, keys, order, sums, block, keep_slot=keep_slot)
    return summed.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: Column | None, name: str) -> DataFrame:
    """Number a key's rows 0, 1, 2, … in ``order``. ``block`` must not decrease along ``order``."""
    if block is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    blocked = _slotted(df, keys, block)
    counts = blocked.groupBy(SLOT).agg(F.count(F.lit(1)).alias("_n"))
    earlier = _neighbours(keys, Window.unboundedPreceding, -1)
    carried = counts.select(SLOT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = blocked.join(carried, SLOT).withColumn(name, F.col("_before") + F.row_number().over(_slot_window(order)) - 1)
    return numbered.drop(SLOT, "_before")


def last_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    block: Column | None,
    include_current: bool = True,
) -> DataFrame:
    """Add one column per entry of ``values``: its latest non-null value at or before (or only before) each row.

    Values of rows without a place in the order are known only to such rows.
    """
    if block is None:
        along = Window.partitionBy(*keys, F.col(order).isNull()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        return df.withColumns({n: F.last(c, ignorenulls=True).over(along) for n, c in values.items()})
    blocked = _slotted(df, keys, block)
    latest = [
        F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_t_{n}") for n, c in values.items()
    ]
    earlier = _neighbours(keys, Window.unboundedPreceding, -1)
    carried = blocked.groupBy(SLOT).agg(*latest).select(
        SLOT, *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values]
    )
    inside = _slot_window(order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    joined = blocked.join(carried, SLOT)
    for name, value in values.items():
        joined = joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(f"_c_{name}")))
    return joined.drop(SLOT, *[f"_c_{n}" for n in values])


def next_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    block: Column | None,
    include_current: bool = False,
) -> DataFrame:
    """Mirror of :func:`last_known`: the nearest non-null value after (or at) each row."""
    if block is None:
        along = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        return df.withColumns({n: F.last(c, ignorenulls=True).over(along) for n, c in values.items()})
    blocked = _slotted(df, keys, block)
    first = [F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_t_{n}") for n, c in values.items()]
    # Backwards, since Spark works a frame that ends at the last row out anew for every row.
    later = Window.partitionBy(*[f"{SLOT}.{k}" for k in keys]).orderBy(F.col(f"{SLOT}.{BLOCK}").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocked.groupBy(SLOT).agg(*first).select(
        SLOT, *[F.last(f"_t_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in values]
    )
    inside = Window.partitionBy(SLOT).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    joined = blocked.join(carried, SLOT)
    for name, value in values.items():
        joined = joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(f"_c_{name}")))
    return joined.drop(SLOT, *[f"_c_{n}" for n in values])
