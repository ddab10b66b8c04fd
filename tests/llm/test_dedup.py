import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import HARD, as_dicts, documents, empty, prose, rows, with_odd_columns
from timeline_lake.llm import near_dedup
from timeline_lake.llm.components import components
from timeline_lake.llm.exact_dedup import exact_duplicates, without_duplicates


@pytest.mark.parametrize("digest", [None, lambda t: F.length(t), lambda t: F.lit(b"one")], ids=["md5", "clashing", "one hash"])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, digest, keep):
    data = HARD + rows("", "same text here", "b", "same  text here", first=50)
    extra = {} if digest is None else {"digest": digest}
    found = {r["doc_id"]: r for r in as_dicts(exact_duplicates(with_odd_columns(documents(spark, data)), keep, **extra))}
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[text or ""].append(doc_id)
    assert len(found) == len(data)
    for text, ids in groups.items():
        top = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            assert found[i] == {"doc_id": i, "keep_id": top, "group_size": len(ids), "kept": i == top, "text_sha256": hashlib.sha256(text.encode()).hexdigest()}


def test_rows_without_ids_and_equal_rows(spark):
    data = [(None, "t", "en", "s", 1), (3, "t", "en", "s", 1), (3, "t", "en", "s", 1), (None, "u", "en", "s", 1), (None, "u", "en", "s", 1)]
    found = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in as_dicts(exact_duplicates(documents(spark, data), "largest")))
    assert found == {(3, 3, 3, True): 2, (None, 3, 3, False): 1, (None, None, 2, True): 2}
    assert without_duplicates(documents(spark, data)).count() == 5
    assert exact_duplicates(empty(spark)).count() == 0
    left = without_duplicates(with_odd_columns(documents(spark)))
    assert left.columns == with_odd_columns(documents(spark)).columns and left.count() == 7


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    draw = random.Random(4)
    edges = {
        "path": [(i, i + 1) for i in range(70)] + [(100, 101)],
        "star": [(50, i) for i in range(40)] + [(i, 50) for i in range(60, 80)],
        "random": [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(90)],
        "none": [],
    }[kind]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in as_dicts(found)} == want and found.count() == len(want)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_force(data):
    sets = {d: shingle_set(t) for d, t, *_ in data}
    edges = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    name = plain_components(edges)
    return {d: (len(s), name.get(d, d), name.get(d, d) == d) for d, s in sets.items()}


def edited(text, changes, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_copies():
    base = prose(9, 150)
    texts = [edited(base, i % 6, i) for i in range(60)]
    # A chain: each is close to the next, the ends are not close.
    chain = [prose(11, 120)]
    for i in range(12):
        chain.append(edited(chain[-1], 2, 1000 + i))
    upper = [prose(12).upper(), prose(12), "One two three", "one TWO three", "one two", "É é", "é é"]
    return HARD + rows(*texts, first=100) + rows(*chain, first=300) + rows(*upper, first=400)


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_match_brute_force(spark, near_copies, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    found = near_dedup.near_duplicates(with_odd_columns(documents(spark, near_copies, 5)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in as_dicts(found)} == brute_force(near_copies)
    assert found.count() == len(near_copies)


def test_near_duplicates_without_ids_or_rows(spark):
    data = [(None, prose(1), "en", "s", 1), (None, prose(1), "en", "s", 1), (5, prose(1), "en", "s", 1), (5, prose(1), "en", "s", 1), (7, prose(1), "en", "s", 1)]
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in as_dicts(near_dedup.near_duplicates(documents(spark, data))))
    assert found == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "None", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    left = near_dedup.without_near_duplicates(documents(spark, data))
    assert left.columns == documents(spark, data).columns and left.count() == 4


def test_block_links_leave_out_what_adds_nothing():
    import numpy as np

    sets = [near_dedup.shingles(edited(prose(20, 150), 1, i)) for i in range(6)]
    side = {
        "class": list(range(6)), "component": [0, 0, 2, 3, 4, 5], "band": [0] * 6, "shingles": [s.tobytes() for s in sets],
        "minima": [(near_dedup._mixed(near_dedup.minima(s)) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets],
        "bands": [near_dedup.bands(near_dedup.minima(s)).tobytes() for s in sets],
    }
    links = near_dedup.block_links(side, None)
    names = plain_components([*links, (0, 1)])
    assert len(links) == 4 and set(names.values()) == {0}
