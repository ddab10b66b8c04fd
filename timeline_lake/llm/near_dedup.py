"""Near duplicates: MinHash with banding, verified on signatures and confirmed on the full shingle sets.

1. Each text becomes the set of its five-word shingles (64-bit hashes), a digest of that set, and the minima of
   ``BANDS * ROWS`` universal hash functions. Texts with one set are one class, so copies are never compared.
2. Classes that agree in all rows of a band share a bucket. With the defaults a pair at similarity 0.85 shares no bucket
   with probability 7e-7.
3. Every member of a bucket is compared with the bucket's least class. Buckets whose members are then in one component are
   done. In the others, members are dealt to blocks, every two blocks meet in one task, and what is not yet linked is
   compared there. Such a task keeps a forest of the links it finds, so neither pairs of a component nor links that add
   nothing are written, and it holds two blocks, however large the bucket is.
4. Components of all links, by alternating stars.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.components import components
from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage

SHINGLE_WORDS = 5
PERCENT = 85
BANDS, ROWS = 30, 6
BLOCK_ROWS = 256
_U8 = np.uint64
# A pair at the threshold agrees in 153 of 180 minima with a standard deviation of 4.8; this is 5.5 of them less.
LEAST_AGREEMENT = 126
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_229)
    return draw.integers(0, 1 << 64, n, dtype=_U8) | _U8(1), draw.integers(0, 1 << 64, n, dtype=_U8)


_A, _B = _multipliers(BANDS * ROWS)
_BAND_A, _BAND_B = _multipliers(ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ x >> _U8(33)) * _U8(m)
    return x ^ x >> _U8(33)


def shingles(text: str) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes. ``bytes.lower`` folds A-Z only, ``bytes.split`` cuts at ASCII white space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, _U8)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U8, len(words))
    k = min(SHINGLE_WORDS, len(words))
    out = np.full(len(h) - k + 1, k, _U8)
    for i in range(k):
        out = _mixed(out * _U8(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of every hash function a*x + b over a set, in parts that stay in the cache."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, _U8)
    for at in range(0, len(hashes), 512):
        np.minimum(out, (hashes[at : at + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return _mixed((rows * _BAND_A + _BAND_B).sum(axis=1, dtype=_U8) + np.arange(BANDS, dtype=_U8)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands. Texts without words have no bands."""

    def rows(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = shingles(text.as_py() or "")
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                out.append((len(found), digest, bands(minima(found)) if len(found) else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.binary()),
                    pa.array([o[2] for o in out], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(rows, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """class, n, shingles (sorted), minima (one byte each), bands of the texts of ``docs``."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t.as_py() or "") for t in part.column(1)]
                least = [minima(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([(_mixed(m) & _U8(255)).astype(np.uint8).tobytes() for m in least], pa.binary()),
                        pa.array([bands(m).tobytes() for m in least], pa.binary()),
                    ],
                    ["class", "shingles", "minima", "bands"],
                )

    asked = docs.select(F.col("class").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(rows, "class long, shingles binary, minima binary, bands binary")


def similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two sets, given as bytes of sorted hashes, reach the similarity."""
    x, y = np.frombuffer(a, _U8), np.frombuffer(b, _U8)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _links_to_least(joined: DataFrame) -> DataFrame:
    """Of candidate pairs with both sides' columns, those that agree on minima and are similar."""

    def rows(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, len(_A)) for i in (1, 4))
            agree = (a == b).sum(axis=1) >= LEAST_AGREEMENT
            keep = [i for i in np.flatnonzero(agree).tolist() if similar(batch.column(2)[i].as_py(), batch.column(5)[i].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(3).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return joined.mapInArrow(rows, "a long, b long")


def block_links(left: dict, right: dict | None) -> list[tuple[int, int]]:
    """A forest of the links between members of two blocks (or within one, if ``right`` is None) of one bucket.

    A block holds lists: class, component, band (number of the bucket's band), minima, bands, shingles. Pairs in one
    component, and pairs that meet in an earlier band too, are left out; so is a pair that an earlier link has joined.
    """
    other = left if right is None else right
    ids, ids2 = np.array(left["class"]), np.array(other["class"])
    m, m2 = (np.stack([np.frombuffer(x, np.uint8) for x in side["minima"]]) for side in (left, other))
    b, b2 = (np.stack([np.frombuffer(x, np.int64) for x in side["bands"]]) for side in (left, other))
    n, n2 = (np.array([len(x) // 8 for x in side["shingles"]]) for side in (left, other))
    components_, components2 = np.array(left["component"]), np.array(other["component"])
    band = left["band"][0]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i in range(len(ids)):
        apart = components_[i] != components2
        if right is None:
            apart[: i + 1] = False
        apart &= 100 * np.minimum(n[i], n2) >= PERCENT * np.maximum(n[i], n2)
        where = np.flatnonzero(apart)
        if not len(where):
            continue
        where = where[(m[i] == m2[where]).sum(axis=1) >= LEAST_AGREEMENT]
        if band and len(where):
            where = where[~(b[i, :band] == b2[where, :band]).any(axis=1)]
        for j in where.tolist():
            x, y = root(int(components_[i])), root(int(components2[j]))
            if x != y and similar(left["shingles"][i], other["shingles"][j]):
                parent[y] = x
                links.append((int(ids[i]), int(ids2[j])))
    return links


def _links_in_blocks(members: DataFrame) -> DataFrame:
    """Links within buckets: every two blocks of a bucket meet in one group."""

    def compare(table: pa.Table) -> pa.Table:
        parts = {p: table.filter(pa.compute.equal(table["own"], p)).to_pydict() for p in (True, False)}
        links = []
        if parts[True]["class"]:
            if table["same"][0].as_py():
                links = block_links(parts[True], None)
            elif parts[False]["class"]:
                links = block_links(parts[True], parts[False])
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("class", "bucket"), F.col("blocks")).cast("int"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), (F.col("block") <= k).alias("own"), (k == F.col("block")).alias("same")
        ),
    )
    met = dealt.withColumn("_at", F.explode(meet)).select(
        "bucket", "band", "class", "component", "minima", "bands", "shingles", F.col("_at.i").alias("i"), F.col("_at.j").alias("j"), F.col("_at.own").alias("own"), F.col("_at.same").alias("same")
    )
    return met.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A component is named by its least doc_id, which is the document that stays. Texts without words, null texts and rows
    with a null doc_id are linked with nothing and stay (component_id is the row's own doc_id). Rows with one doc_id are
    one document.
    """
    signed = cut_lineage(signatures(docs))
    worded = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(worded.groupBy("digest").agg(F.min("doc_id").alias("class"), F.min_by("bands", "doc_id").alias("bands")))
    dealt = classes.select("class", F.posexplode("bands").alias("band", "bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    candidates = cut_lineage(dealt.join(shared, "bucket"))

    wanted = candidates.select("class").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("class"), "text").join(wanted, "class", "left_semi")
    sets = cut_lineage(full_sets(texts))

    pairs = candidates.filter("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    a = sets.select(F.col("class").alias("a"), F.col("minima").alias("minima_a"), F.col("shingles").alias("shingles_a"))
    b = sets.select(F.col("class").alias("b"), F.col("minima").alias("minima_b"), F.col("shingles").alias("shingles_b"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "minima_a", "shingles_a", "b", "minima_b", "shingles_b")
    # Documents with one id are one document, whatever their texts.
    stars = cut_lineage(_links_to_least(joined))
    first = cut_lineage(components(stars))

    named = candidates.join(first, candidates["class"] == first["node"], "left").select(
        "bucket", "band", "class", F.coalesce("component", "class").alias("component")
    )
    open_ = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    # A bucket of two has already been compared.
    large = candidates.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("bucket")
    members = named.join(open_.join(large, "bucket", "left_semi"), "bucket", "left_semi").join(sets, "class")
    rest = cut_lineage(_links_in_blocks(members))

    linked = components(stars.unionAll(rest))
    owners = worded.select("doc_id", "digest").join(classes.select("digest", "class"), "digest")
    # A document with several rows belongs to the classes of all of them.
    by_id = owners.filter("doc_id <> class").select(F.col("doc_id").alias("node"), "class")
    named_ids = by_id.join(linked.withColumnRenamed("node", "class"), "class", "left").groupBy("node").agg(
        F.min(F.coalesce("component", "class")).alias("component")
    )
    found = linked.unionByName(named_ids).groupBy("node").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document of each component, and all without a doc_id."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(given(spark, folder, "documents"))
