import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import HARD, LONG, as_dicts, documents, empty, prose, rows, with_odd_columns
from timeline_lake.llm import chat, collocations, filter_audit

LABELS = "doc_id long, quality int, toxic int"
TURN = "conv_id long, turn long, role string, text string"


# --- filter audit ----------------------------------------------------------------------------------------------------


def failed(text, repeated):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    bits = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), repeated]
    return {f for f, b in zip("ABCDE", bits) if b}


def plain_audit(data, labels):
    least = {}
    for d, t, *_ in data:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    docs = [(d, lang or "", failed(t or "", d is not None and d > least[t or ""])) for d, t, lang, *_ in data]
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(d, f) for d, p, f in docs if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                here, gone = [x for x in left if f in x[1]], [x for x in mine if f in x[1] and set(order[:i]) & x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(here)
                out[part, "".join(order), i + 1] = [len(left), len(here), len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
        for (p, order, step), value in out.items():
            if p == part:
                value.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, **more):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = filter_audit.audit(filter_audit.mask_counts(docs, spark.createDataFrame(labels, LABELS), **more)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found}


def mixed_documents():
    draw = random.Random(4)
    texts = [prose(i % 9, 150) for i in range(12)] + [prose(50, 120) + " #", prose(51, 130).upper(), "A", " ".join(["one"] * 120), prose(52, 99), prose(52, 100), "É" * 30, "a\x0bb\x85c"]
    texts += [draw.choice(texts) for _ in range(20)]
    data = [(i, t, draw.choice(["en", "de", None, ""]), "s", 0) for i, t in enumerate(texts)] + [(d, t, lang, s, n) for d, t, lang, s, n in HARD]
    return data + [(3, texts[3], "en", "s", 0), (None, texts[0], "en", "s", 0), (None, "only here", None, "s", 0)]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long") % 3, lambda c: F.lit(7).cast("long")])
def test_audit_equals_the_plain_one(spark, digest):
    """Also with hashes that many texts share, where rows are told apart by their texts."""
    data = mixed_documents()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)]
    assert audited(spark, with_odd_columns(documents(spark, data)), labels, digest=digest) == plain_audit(data, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, empty(spark), []) == {}


def test_sketch_never_clears_a_repeated_text(spark):
    hashes = spark.range(3000).select(F.xxhash64(F.col("id") % 2500).alias("_hash"))
    kept = {r[0] for r in filter_audit.possible_repeats(hashes).collect()}
    repeated = {r[0] for r in hashes.groupBy("_hash").count().filter("count > 1").collect()}
    assert repeated <= kept and len(kept) < len(repeated) + 100
    # A row whose places coincide raises a counter once.
    alone = spark.range(500).select(F.xxhash64("id").alias("_hash"))
    assert filter_audit.shared_counters(alone.limit(1), 1).count() == 0


# --- chat ------------------------------------------------------------------------------------------------------------


def plain_digests(turns):
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, listed in convs.items():
        listed.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in listed)
        loss = "".join(t for _, r, t in listed if r == "assistant")
        out[conv] = (len(listed), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


NASTY = [
    "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "[\\INST]", "[INST", "]", "<s><s></s>", "[AS][TURN]", "a\\[/INST]\\", "", None, "é🙂日本\n\n[OUT]", "[[INST]]", "<\\/s>", "$1 \\1 $0", LONG[:5000],
]


def test_chat_round_trip(spark, tmp_path):
    draw = random.Random(6)
    turns = []
    for conv in range(25):
        for turn in range(draw.randint(1, 12)):
            text = draw.choice(NASTY) if draw.random() < 0.6 else "".join(draw.choice("<>/s[]INSTOUAYR\\ \n") for _ in range(40))
            turns.append((conv, turn, draw.choice(["user", "assistant", "system", "tool [/INST]", None, "\\x"]), text))
    turns += [(30, None, "user", "first"), (30, 5, "user", "x"), (30, 5, "user", "x"), (30, 5, "assistant", "x"), (None, 0, "user", "no id"), (31, 70_000, "assistant", "far"), (31, 0, "user", "near")]
    frame = with_odd_columns(spark.createDataFrame(turns, TURN)).withColumn("loss", F.lit("x")).withColumn("place", F.lit("x")).repartition(5)
    written, order = chat.write_conversations(frame, str(tmp_path / "chat"))
    found = {r["conv_id"]: r for r in as_dicts(chat.read_digests(written))}
    want = plain_digests(turns)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in found.items()} == want
    whole = {}
    for r in sorted(as_dicts(written), key=lambda r: (str(r["conv_id"]), r["place"], r["piece"])):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    assert {c: len(t) for c, t in whole.items()} == {c: r["formatted_chars"] for c, r in found.items()}
    # The joined text alone gives the same turns.
    for conv, text in whole.items():
        reader = chat.Reader(chat.INSTRUCT)
        reader.add(text, False)
        assert reader.row()[:2] == want[conv][:2]
    assert {r["conv_id"]: r["n_turns"] for r in as_dicts(order)} == {c: w[0] for c, w in want.items()}


def test_role_machine(spark):
    runs = {
        1: "su", 2: "sua", 3: "uaua", 4: "a", 5: "uu", 6: "s", 7: "usa", 8: "uax", 9: "x", 10: "ssu", 11: "u", 12: "aa",
    }
    names = {"s": "system", "u": "user", "a": "assistant", "x": ""}
    turns = [(c, i, names[r], "t") for c, order in runs.items() for i, r in enumerate(order)]
    found = {r["conv_id"]: (r["n_misplaced"], r["valid"]) for r in as_dicts(chat.check_order(chat.numbered_turns(spark.createDataFrame(turns, TURN))))}
    assert {c for c, (_, valid) in found.items() if valid} == {1, 2, 3, 11}
    assert {c: n for c, (n, _) in found.items()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 2, 8: 1, 9: 1, 10: 1, 11: 0, 12: 2}


def test_templates_whose_marks_cannot_be_told_apart_are_refused():
    def template(user, close="[/U]"):
        return chat.Template({"user": chat.Turn(user, close)}, {"": ("user",)}, ("user",))

    template("[U]")
    for user, close in (("<s>", "[/U]"), ("[A", "[A]"), ("abab", "ba"), ("a\\b", "[/U]"), ("x", "[/U]"), ("aba", "[/U]"), ("[U]", "[U]")):
        with pytest.raises(ValueError):
            template(user, close)


def test_no_conversations(spark, tmp_path):
    written, order = chat.write_conversations(spark.createDataFrame([], TURN), str(tmp_path / "chat"))
    assert chat.read_digests(written).count() == 0 and order.count() == 0


def test_broken_text_is_noticed():
    for text in ("[INST]a[/INST]", "<s>x", "<s>[INST]a</s>", "<s>[INST]a", "<s>[INST]a[/INST][INST]"):
        reader = chat.Reader(chat.INSTRUCT)
        with pytest.raises(ValueError):
            reader.add(text, False)
            reader.row()


# --- phrases ---------------------------------------------------------------------------------------------------------


def plain_collocations(data, least, most, longest=4):
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = {}
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around.get(p[i : i + size], 0), a)
        scored = []
        for p, a in cand.items():
            if 100 * around.get(p, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "ÉÉ", "a\x00b", "x.y", "日本", "und"] + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(draw.randint(0, 60)):
            text += draw.choice(["New York city hall", "in spite of", draw.choice(words), draw.choice(words[:5])]) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "])
        texts.append(text)
    data = [(i, t, draw.choice(["en", "en", "de", None, "und"]), "s", 0) for i, t in enumerate(texts)]
    return data + [(900, None, "en", "s", 0), (901, "", "fr", "s", 0), (902, " \t\n.", None, "s", 0), (903, "ha " * 3000, "en", "s", 0), (904, "No. end", "fr", "s", 0)]


@pytest.mark.parametrize("least,capacity,most,chunk", [(3, 1 << 18, 2000, 1 << 21), (3, 16, 50, 700), (12, 40, 7, 64), (30, 1, 2000, 1 << 21)])
def test_collocations_equal_the_plain_ones(spark, least, capacity, most, chunk):
    """Also with many hash partitions and summaries that have to let go of keys."""
    data = corpus(least)
    got = collocations.collocations(with_odd_columns(documents(spark, data)), least=least, most=most, capacity=capacity, chunk_words=chunk).collect()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(data, least, most)
    assert sorted(tuple(r[n] for n in names) for r in got) == want and len(want) > 5


def test_no_phrases(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(documents(spark, HARD[:5])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 6_000_000_000_000
    score = spark.range(1).select(F.expr(f"(cast(2000000 as decimal(38, 0)) * cast({a} as bigint)) div (cast(cast({a + 1} as bigint) as decimal(20, 0)) + cast({a} as bigint))").alias("s")).first()[0]
    assert score == 2_000_000 * a // (2 * a + 1)


def test_summaries_keep_every_frequent_key():
    draw = np.random.default_rng(1)
    for threshold in (5, 20):
        weights = np.concatenate([draw.integers(1, 4, 4000), draw.integers(threshold, 3 * threshold, 30)])
        keys = draw.integers(0, 1 << 62, len(weights)).astype(np.uint64)
        packets = [(keys[part], weights[part] // 3 + (np.arange(len(part)) % 2)) for part in np.array_split(draw.permutation(np.tile(np.arange(len(keys)), 3)), 9)]
        true = Counter()
        for k, w in packets:
            for a, b in zip(k.tolist(), w.tolist()):
                true[a] += b
        mass = sum(true.values())
        summary = collocations.MisraGries(mass // threshold + 1)
        for k, w in packets:
            order = np.argsort(k)
            summary.add(k[order], w[order].astype(np.int64))
            summary.settle()
        possible = set(summary.possible(threshold).tolist())
        assert {k for k, n in true.items() if n >= threshold} <= possible
        assert summary.error <= mass / (summary.capacity + 1) < threshold and len(summary.settle()[0]) <= summary.capacity
        kept = dict(zip(*(x.tolist() for x in summary.settle())))
        assert all(n - summary.error <= kept.get(k, 0) <= n for k, n in true.items())
