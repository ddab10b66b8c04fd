"""Maintenance of keyed tables as batch merges: every function returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeline_lake.functions.text import slugify
from timeline_lake.operators.blocks import row_numbers


def _one_per_key(batch: DataFrame, keys: list[str], order: str | None, last: bool) -> DataFrame:
    """The last or first row of each key in ``order``; without one, the greatest or least row. Added up before the shuffle."""
    row = F.struct(*batch.columns)
    if order is None:
        chosen = F.max(row) if last else F.min(row)
    else:
        # Rows with equal order are told apart by their values, so a repeated run chooses the same one.
        place = F.struct(order, row)
        chosen = (F.max(place) if last else F.min(place))["col2"]
    return batch.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(chosen.alias("_row")).select("_row.*")


def upsert(
    table: DataFrame,
    batch: DataFrame,
    keys: list[str],
    update: list[str] | None = None,
    always: dict[str, Column] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Insert the batch's new keys and overwrite columns of known ones.

    ``update`` lists the columns a known key takes from the batch (default: all but `created`); a null in the batch
    overwrites too. ``always`` sets columns of every batch row. Rows of one key count as if applied in ``order`` (a column
    of the batch): a new key is inserted as its first row says and then takes the updated columns of its last.
    """
    changed = [c for c in table.columns if c not in keys and c != "created"] if update is None else update
    placed = batch.withColumns(always or {})
    fresh = _one_per_key(placed, keys, order, last=True)
    fixed = [c for c in table.columns if c not in keys and c not in changed]
    if fixed:
        first = _one_per_key(placed, keys, order, last=False).select(*keys, *[F.col(c).alias(f"_f_{c}") for c in fixed])
        fresh = fresh.drop(*fixed).join(first, keys).withColumnsRenamed({f"_f_{c}": c for c in fixed})
    marked = fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_new"))
    joined = table.withColumn("_old", F.lit(True)).join(marked, keys, "full_outer")
    taken = {}
    for name in table.columns:
        if name in keys:
            continue
        known = F.col(f"_n_{name}") if name in changed else F.col(name)
        taken[name] = F.when(F.col("_new").isNull(), F.col(name)).when(F.col("_old").isNull(), F.col(f"_n_{name}")).otherwise(known)
    return joined.select(*keys, *[c.alias(n) for n, c in taken.items()]).select(*table.columns)


def insert_or_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append rows with new keys only; of several rows of one key the first in ``order`` counts.

    Returns the new table and the rows inserted, for their children to follow.
    """
    inserted = _one_per_key(batch, keys, order, last=False).join(table.select(*keys), keys, "left_anti").select(*table.columns)
    return table.unionByName(inserted), inserted


def children_of(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def replace_children(table: DataFrame, saved_parents: DataFrame, fresh: DataFrame, keys: list[str], order: list[str], index: str, block: Column) -> DataFrame:
    """Drop all children of the saved parents and add the new ones, numbered from 0 in ``order``.

    ``block`` must not decrease along ``order``; it keeps a parent with very many children out of a single task.
    """
    kept = table.join(saved_parents.select(*keys).distinct(), keys, "left_anti")
    numbered = row_numbers(fresh, keys, order, block, "_index").withColumn(index, F.col("_index")).drop("_index")
    return kept.unionByName(numbered.select(*table.columns))


def parent_rollup(parents: DataFrame, saved: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """After saving scenes: their count, the longer of known and new duration, and status `analyzed` on saved parents."""
    sums = children.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("end_time").alias("_end"))
    touched = saved.select(*keys).distinct().withColumn("_saved", F.lit(True))
    joined = parents.join(touched, keys, "left").join(sums, keys, "left")
    ours = F.col("_saved").isNotNull()
    return joined.withColumns(
        {
            "scene_count": F.when(ours, F.coalesce("_n", F.lit(0))).otherwise(F.col("scene_count")),
            "duration_seconds": F.when(ours, F.greatest("duration_seconds", F.coalesce("_end", F.lit(0.0)))).otherwise(F.col("duration_seconds")),
            "status": F.when(ours, F.lit("analyzed")).otherwise(F.col("status")),
        }
    ).select(*parents.columns)


def delete_keys(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def deletion_report(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per requested key: whether there was anything to delete."""
    known = table.select(*keys).distinct().withColumn("_known", F.lit(True))
    return doomed.select(*keys).distinct().join(known, keys, "left").select(*keys, F.col("_known").isNotNull().alias("deleted"))


def cascade_delete(tables: dict[str, DataFrame], links: dict[str, tuple[str, dict[str, str]]], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete keys of ``root`` and whatever hangs on them.

    ``links``: child table → (parent table, {child column: parent column}), parents before children. Rows go with
    their parent's key, so a table whose link columns include the root's key is filtered by that key directly.
    """
    gone = {root: doomed}
    left = {root: delete_keys(tables[root], doomed, doomed.columns)}
    for child, (parent, columns) in links.items():
        if parent not in gone:
            left[child] = tables[child]
            continue
        lost = gone[parent].select(*[F.col(p).alias(c) for c, p in columns.items() if p in gone[parent].columns])
        gone[child] = lost
        left[child] = delete_keys(tables[child], lost, lost.columns)
    return left


def set_columns(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Replace columns of the keys listed in ``changes``; null replaces as well."""
    marked = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(marked, keys, "left")
    for name in columns:
        joined = joined.withColumn(name, F.when(F.col("_hit"), F.col(f"_n_{name}")).otherwise(F.col(name)))
    return joined.select(*table.columns)


def unique_slugs(requests: DataFrame, taken: DataFrame, scope: list[str], order: list[str], block: Column, tries: int = 100) -> DataFrame:
    """Give each request (scope, base, …) a slug free in its scope: base, base-2 … base-100, then a hashed suffix.

    Of several requests for one base the k-th, in ``order``, takes the k-th free name. A name that some request asks for
    as its base goes to such a request, so it counts as taken for the numbers of another base. Numbered names of two bases
    never meet, as a name without its last number is its base. Hashed suffixes differ by construction within a base (an
    odd multiple of the rank modulo 2^32); one that is taken or asked for is lengthened. Null scopes are a scope of their
    own. ``taken``: scope, slug. At most ``tries`` taken names per base matter, and only those are kept.
    """
    inside = F.struct(*[F.col(c) for c in scope], F.lit(0).alias("_")) if scope else F.struct(F.lit(0).alias("_"))
    ranked = row_numbers(requests, [*scope, "base"], order, block, "_k").withColumn("_key", F.struct(inside.alias("in"), F.col("base")))
    given = taken.select(inside.alias("in"), "slug")
    asked = requests.select(inside.alias("in"), F.col("base").alias("slug"))
    number = F.regexp_extract("slug", "-([0-9]+)$", 1).try_cast("int")
    suffixed = given.unionByName(asked).select(F.struct("in", F.regexp_replace("slug", "-[0-9]+$", "").alias("base")).alias("_key"), number.alias("_number"), "slug").filter(
        F.col("_number").between(2, tries) & (F.concat(F.col("_key.base"), F.lit("-"), F.col("_number")) == F.col("slug"))
    )
    plain = given.select(F.struct("in", F.col("slug").alias("base")).alias("_key"), F.lit(1).alias("_number"))
    used = plain.unionByName(suffixed.drop("slug")).groupBy("_key").agg(F.collect_set("_number").alias("_used"))
    free = F.array_except(F.sequence(F.lit(1), F.lit(tries)), F.coalesce("_used", F.array().cast("array<int>")))
    numbered = ranked.join(used, "_key", "left").withColumn("_number", F.get(free, F.col("_k").cast("int")))
    suffix = F.lower(F.lpad(F.hex(F.pmod((F.col("_k") % F.lit(1 << 32)) * F.lit(0x9E3779B1), F.lit(1 << 32))), 8, "0"))
    named = numbered.withColumn(
        "slug",
        F.when(F.col("_number") == 1, F.col("base"))
        .when(F.col("_number").isNotNull(), F.concat(F.col("base"), F.lit("-"), F.col("_number")))
        .otherwise(F.concat(F.col("base"), F.lit("-"), suffix)),
    ).drop("_k", "_used")
    hashed = named.filter(F.col("_number").isNull())
    known = given.unionByName(asked).filter(F.col("slug").rlike("-[0-9a-f]{8}$")).distinct().select(F.struct("in", F.col("slug").alias("base")).alias("_name"), F.lit(True).alias("_met"))
    longer = F.concat(F.col("slug"), F.substring(F.sha2(F.concat_ws("/", F.to_json("_key"), "slug"), 256), 1, 24))
    apart = hashed.withColumn("_name", F.struct("_key.in", F.col("slug").alias("base"))).join(known, "_name", "left").withColumn("slug", F.when(F.col("_met"), longer).otherwise(F.col("slug")))
    done = named.filter(F.col("_number").isNotNull()).drop("_key", "_number")
    return done.unionByName(apart.select(*done.columns))


def get_or_create(table: DataFrame, names: DataFrame, defaults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Projects by name: reuse the one whose slug and name both match, else create it under a free slug.

    Returns the new table and the answer per distinct name (name, slug, created_now). New names are numbered in the order
    of their MD5, whose leading digits also spread them over blocks; a null name is slugged like an empty one.
    """
    asked = names.select("name").distinct().withColumn("base", F.coalesce(slugify("name"), F.lit("untitled")))
    known = table.select(F.struct(F.col("slug").alias("base"), "name").alias("_key")).distinct()
    keyed = asked.withColumn("_key", F.struct("base", "name"))
    reused = keyed.join(known, "_key", "left_semi").select("name", F.col("base").alias("slug"), F.lit(False).alias("created_now"))
    missing = keyed.join(known, "_key", "left_anti").select("name", "base", F.md5(F.coalesce("name", F.lit(""))).alias("_md5"))
    made = unique_slugs(missing, table.select("slug"), [], ["_md5"], F.substring("_md5", 1, 3)).select("name", "slug")
    rows = made.select("slug", "name").withColumns(defaults)
    answers = reused.unionByName(made.select("name", "slug", F.lit(True).alias("created_now")))
    return table.unionByName(rows.select(*table.columns)), answers


def constraint_audit(
    tables: dict[str, DataFrame], keys: dict[str, list[str]], required: dict[str, list[str]], foreign: list[tuple[str, list[str], str, list[str]]]
) -> DataFrame:
    """Violations by table and rule: duplicate keys, nulls in required columns, children without a parent."""
    found: list[DataFrame] = []

    def note(rows: DataFrame, table: str, rule: str, key: list[Column]) -> None:
        found.append(rows.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key")))

    for name, key in keys.items():
        repeated = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        note(repeated, name, "duplicate key", [F.col(k) for k in key])
    for name, columns in required.items():
        for column in columns:
            note(tables[name].filter(F.col(column).isNull()), name, f"{column} is null", [F.col(k) for k in keys[name]])
    for child, columns, parent, parent_columns in foreign:
        owners = tables[parent].select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]).distinct()
        note(tables[child].join(owners, columns, "left_anti"), child, f"no {parent} row", [F.col(k) for k in keys[child]])
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _comparable(name: str, kind: str) -> Column:
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
    if kind in ("double", "float"):
        return F.round(F.col(name) * 1000) / F.lit(1000.0)
    return F.col(name)


def parity_diff(db: DataFrame, disk: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Compare two copies of a table by key: OK, MISSING_IN_DB, MISSING_ON_DISK or DIFFER with the differing fields.

    Times are compared to the second and doubles to three places, so harmless jitter is not reported.
    """
    kinds = dict(db.dtypes)

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*keys, *[_comparable(f, kinds[f]).alias(f"_{mark}_{f}") for f in fields], F.lit(True).alias(f"_{mark}"))

    joined = side(db, "db").join(side(disk, "md"), keys, "full_outer")

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    parts = [
        F.when(~F.col(f"_db_{f}").eqNullSafe(F.col(f"_md_{f}")), F.concat(F.lit(f"{f}: db="), shown(f"_db_{f}"), F.lit(" md="), shown(f"_md_{f}")))
        for f in sorted(fields)
    ]
    both = F.col("_db").isNotNull() & F.col("_md").isNotNull()
    detail = F.when(both, F.concat_ws("; ", *parts)).otherwise(F.lit(""))
    kind = (
        F.when(F.col("_db").isNull(), F.lit("MISSING_IN_DB"))
        .when(F.col("_md").isNull(), F.lit("MISSING_ON_DISK"))
        .when(detail != "", F.lit("DIFFER"))
        .otherwise(F.lit("OK"))
    )
    return joined.select(*keys, kind.alias("kind"), detail.alias("detail"))


def parity_children(db: DataFrame, disk: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Per parent that has children on disk: same count, same first and last child."""

    def ends(df: DataFrame, mark: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{mark}_count"), F.min_by(value, index).alias(f"{mark}_first"), F.max_by(value, index).alias(f"{mark}_last")
        )

    joined = ends(disk, "md").join(ends(db, "db"), keys, "left")
    counts = F.coalesce("db_count", F.lit(0)) == F.col("md_count")
    ends_match = F.col("db_first").eqNullSafe(F.col("md_first")) & F.col("db_last").eqNullSafe(F.col("md_last"))
    kind = F.when(~counts, F.lit("COUNT_DIFFERS")).when(~ends_match, F.lit("ENDS_DIFFER")).otherwise(F.lit("OK"))
    return joined.select(*keys, F.coalesce("db_count", F.lit(0)).alias("db_count"), "md_count", kind.alias("kind"))


def parity_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
