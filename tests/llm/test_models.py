import pickle
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import HARD, LONG, as_dicts, documents, empty, prose, rows, with_odd_columns
from timeline_lake.llm import quality_rank, quality_rules, toxicity
from timeline_lake.llm.labels import label_sample, remainder
from timeline_lake.llm.text_figures import base_figures

LABELS = "doc_id long, quality int, toxic int"


def test_label_sample(spark):
    data = [(1, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, 1), (3, None, 0), (None, 1, 1), (4, 0, 0), (5, 1, 1), (5, 1, 1)]
    labels = with_odd_columns(spark.createDataFrame(data, LABELS))
    found = {r["doc_id"]: r["label"] for r in as_dicts(label_sample(labels, "quality", 4, 2, 100))}
    votes = {1: 1, 4: 0, 5: 1}
    assert found == {i: y for i, y in votes.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    assert label_sample(labels, "toxic", 5, 0, 1).count() == 1
    assert as_dicts(spark.range(3).select(remainder("id", 5).alias("r"))) == [{"r": zlib.crc32(str(i).encode()) % 5} for i in range(3)]


# --- rules -----------------------------------------------------------------------------------------------------------


def plain_figures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize(
    "text", ["", " \n ", "a b c a b c", "x\nx\n\n \nx", "a a a a", "a b a b a b", "é|<>|#\x0b\x0c z\xa0y", LONG, prose(2) + "\n" + prose(2), "a\x1cb\x85c d"], ids=range(10)
)
def test_base_figures(text):
    assert base_figures(text, text.encode()) == plain_figures(text)


def corpus():
    clean = rows(*[prose(i, 90) for i in range(60)])
    symbols = rows(*[" ".join(w + "&&&***" for w in prose(i, 90).split()) for i in range(100, 108)], first=100)
    return clean + symbols + rows(None, "", "short", prose(1, 9) * 9, first=200)


def test_rules_match_a_plain_version(spark):
    data = corpus()
    found = {r["doc_id"]: r for r in as_dicts(quality_rules.judge(with_odd_columns(documents(spark, data))))}
    raw, good = Counter(), Counter()
    grams = {d: [int(g) for part in quality_rules.buckets((t or "").encode()) for g in part] for d, t, *_ in data}
    for d, t, *_ in data:
        raw.update(grams[d])
        if quality_rules.trusted(*plain_figures(t or "")):
            good.update(grams[d])
    share = sum(good.values()) / sum(raw.values())
    half = quality_rules.SMOOTHING
    for d, t, *_ in data:
        figures = plain_figures(t or "")
        failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
        assert [found[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == [*figures, failed]
        if failed:
            assert found[d]["kept"] is False and found[d]["log_ratio"] is None
            continue
        ratio = np.mean([np.log((good[g] + half) / (raw[g] * share + half)) for g in grams[d]])
        assert found[d]["log_ratio"] == pytest.approx(ratio, abs=1e-5) and found[d]["kept"] == (ratio >= quality_rules.THRESHOLD)
    assert all(found[i]["kept"] for i in range(60)) and not any(found[i]["kept"] for i in range(100, 108))


def test_rules_keep_whole_rows(spark):
    docs = with_odd_columns(documents(spark, corpus()))
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(60))
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.keep_good(empty(spark)).count() == 0
    assert len(as_dicts(quality_rules.judge(documents(spark)))) == len(HARD)


def test_buckets_of_a_long_text_in_parts(monkeypatch):
    data = LONG.encode()
    whole = np.concatenate(list(quality_rules.buckets(data)))
    monkeypatch.setattr(quality_rules, "_SLICE", 1000)
    assert (np.concatenate(list(quality_rules.buckets(data))) == whole).all() and len(whole) == len(data) - 3


# --- ranking ---------------------------------------------------------------------------------------------------------


def test_preferences_are_learned():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] > 0.3).astype(float)
    model = quality_rank.Ranking(x, y)
    w = model.weights / model.spread
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    assert ((model.plain_scores(x) >= model.cut) == y).mean() > 0.97


def test_the_cut_is_a_quantile_that_separates_best():
    assert quality_rank.score_cut(np.array([1.0, 2, 3, 4]), np.array([0.0, 0, 1, 1])) == 2.5
    assert quality_rank.score_cut(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 1, 1])) < 1
    assert quality_rank.score_cut(np.array([1.0, 1]), np.array([0.0, 0])) > 1


@pytest.mark.parametrize("kind", ["apart", "mixed", "one label", "no label", "far"])
def test_the_cut_is_a_quantile_of_all_scores(spark, kind):
    draw = np.random.default_rng(3)
    n = 400
    truth = draw.random(n) < 0.6
    plain = {"apart": truth * 4.0, "mixed": truth * 1.0, "one label": truth * 4.0, "no label": truth * 4.0, "far": truth * 1e9}[kind] + draw.normal(size=n) * 0.5
    known = {"one label": truth, "no label": np.zeros(n, bool)}.get(kind, draw.random(n) < 0.7)
    model = quality_rank.Ranking(np.array([[0.0, 0], [1, 1], [2, 2], [0.5, 0.5]]), np.array([0.0, 0, 1, 1]))
    model.cut, model.range = 1.0, 1.0 / quality_rank.RANGES
    scored = spark.createDataFrame([(None if i % 50 == 7 else i, float(plain[i])) for i in range(n)], "doc_id long, plain double")
    usable = [i for i in range(n) if known[i] and i % 50 != 7]
    labels = spark.createDataFrame([(i, int(truth[i])) for i in usable] + [(10_000, 1)], "doc_id long, label int")
    cut = quality_rank.quantile_cut(scored, labels, model, "plain")
    if kind in ("one label", "no label"):
        assert cut == model.cut
        return
    # Against every border between two ranges of scores that occur.
    ranges = np.clip(np.floor((plain - model.cut) / model.range), -quality_rank.FURTHEST, quality_rank.FURTHEST - 1)
    right = {b: sum((ranges[i] >= b) == truth[i] for i in usable) for b in [*np.unique(ranges), np.inf]}
    assert sum((plain[i] >= cut) == truth[i] for i in usable) == max(right.values())
    below = {b: int((ranges < b).sum()) for b, r in right.items() if r == max(right.values())}
    middle = (min(below.values()) + max(below.values())) / 2
    assert abs(int((plain < cut).sum()) - middle) == min(abs(v - middle) for v in below.values())


def test_ranking_on_documents(spark):
    data = corpus()
    sample = spark.createDataFrame([(d, int(d < 60)) for d, *_ in data if d % 3 and d < 200], "doc_id long, label int")
    docs = with_odd_columns(documents(spark, data))
    model = quality_rank.fit(docs, sample)
    scores = {r["doc_id"]: r["score"] for r in as_dicts(quality_rank.rank(docs, model))}
    assert len(scores) == len(data) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[d] >= 0.7) == (d < 60) for d in [*range(60), *range(100, 108)])
    left = quality_rank.keep_accepted(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, s in scores.items() if s >= 0.7}
    labels = spark.createDataFrame([(d, int(d < 60)) for d, *_ in data if d < 200], "doc_id long, label int")
    by_all = {r["doc_id"]: r["score"] for r in as_dicts(quality_rank.rank(docs, model, labels))}
    assert len(by_all) == len(data) and all((by_all[d] >= 0.7) == (d < 60) for d in [*range(60), *range(100, 108)])
    left = quality_rank.keep_accepted(docs, model, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, s in by_all.items() if s >= 0.7}
    assert quality_rank.keep_accepted(empty(spark), model, labels).count() == 0 and quality_rank.rank(docs, None, labels).count() == len(data)
    one_sided = sample.filter("label = 1")
    assert quality_rank.fit(docs, one_sided) is None
    assert {r["score"] for r in as_dicts(quality_rank.rank(docs, None))} == {0.7}
    assert quality_rank.rank(empty(spark), model).count() == 0 and quality_rank.fit(empty(spark), sample) is None
    assert quality_rank.rank(documents(spark), model).count() == len(HARD)


def test_features_of_hard_texts():
    for text in [t or "" for _, t, *_ in HARD]:
        found = quality_rank.features(text, text.encode())
        assert len(found) == len(quality_rank.FEATURES) and all(0 <= x <= 3 for x in found)


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_neighbours_are_the_exact_ones():
    draw = np.random.default_rng(2)
    n_terms = 40
    vectors = []
    for _ in range(700):
        index = np.sort(draw.choice(n_terms, draw.integers(0, 6), replace=False))
        vectors.append((index, draw.integers(1, 5, len(index)).astype(float)))
    idf = draw.uniform(1, 4, n_terms)
    index = toxicity.BlockMaxIndex(vectors, np.zeros(700), idf, block=16)
    dense = np.zeros((700, n_terms))
    for row, (i, c) in enumerate(vectors):
        dense[row, i] = index.unit(i, c)
    for i, c in vectors[:200]:
        rows_, cosines = index.nearest(i, c, k=7)
        query = np.zeros(n_terms)
        query[i] = index.unit(i, c)
        want = np.sort((dense @ query)[dense @ query > 1e-12])[::-1][:7]
        assert np.allclose(cosines, want, atol=1e-9) and np.allclose((dense @ query)[rows_], cosines)


def test_term_counts_agree_with_whole_counts():
    for text in ["", "The the THE other, others; otherwise other", prose(4, 300), "ab1cd é_é x", LONG]:
        everything = toxicity.text_terms(text)
        vocabulary = {t: i for i, t in enumerate(sorted(everything))}
        assert toxicity.TermCounts(vocabulary).count(text) == {vocabulary[t]: n for t, n in everything.items()}


def test_monotone_fit():
    x, y = toxicity.monotone_fit(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] == 0 and y[-1] == 1
    assert np.interp(0.25, x, y) == 0.5


def test_toxic_documents_are_found(spark):
    bad = [prose(i, 60) + " scoundrel " + prose(500 + i, 20) + " villain" for i in range(30)]
    data = rows(*[prose(i, 80) for i in range(1000, 1090)]) + rows(*bad, first=100) + rows(None, "", first=200)
    sample = spark.createDataFrame([(d, int(100 <= d < 200)) for d, *_ in data if d % 3 and d < 200], "doc_id long, label int")
    found = {r["doc_id"]: r for r in as_dicts(toxicity.nearest_labelled(with_odd_columns(documents(spark, data)), sample))}
    assert len(found) == len(data)
    assert all(found[d]["score"] >= 0.5 for d in range(100, 130)) and all(found[d]["score"] < 0.5 for d in [*range(90), 200, 201])
    assert all(set(found[d]["neighbour_ids"]) <= set(range(100, 130)) and found[d]["neighbour_ids"] for d in range(100, 130))
    nobody = sample.filter("label = 0")
    assert {r["score"] for r in as_dicts(toxicity.nearest_labelled(documents(spark, data), nobody))} == {0.0}
    assert toxicity.nearest_labelled(empty(spark), sample).count() == 0


def test_rare_terms_are_pruned_by_block_and_exact():
    draw = np.random.default_rng(3)
    vectors = [(np.sort(draw.choice(3000, draw.integers(0, 60), replace=False)), None) for _ in range(900)]
    vectors = [(i, draw.integers(1, 5, len(i)).astype(float)) for i, _ in vectors]
    idf = draw.uniform(1, 4, 3000)
    index = toxicity.BlockMaxIndex(vectors, np.zeros(900), idf, block=16, frequent=50)
    assert (index.column < 0).any()
    index = pickle.loads(pickle.dumps(index))
    dense = np.zeros((900, 3000))
    for row, (i, c) in enumerate(vectors):
        dense[row, i] = index.unit(i, c)
    for at, (rows_, cosines) in enumerate(index.nearest_of(vectors[:100], 7, list(range(100)))):
        all_ = dense @ dense[at]
        all_[at] = 0
        assert at not in rows_ and np.allclose(cosines, np.sort(all_[all_ > 1e-12])[::-1][:7], atol=1e-12) and np.allclose(all_[rows_], cosines)


def test_every_text_has_the_neighbours_of_all_its_terms(spark):
    # Each insult stands in one text only, so no term goes with the label beyond chance.
    data = rows(*[prose(i, 60) for i in range(40)]) + rows(*[f"{prose(300 + i, 40)} {'xyzw'[i]}illain{i}" for i in range(4)], first=100) + rows(prose(3, 60), first=200)
    sample = spark.createDataFrame([(d, int(100 <= d < 200)) for d, *_ in data if d < 200], "doc_id long, label int")
    found = {r["doc_id"]: r for r in as_dicts(toxicity.nearest_labelled(documents(spark, data), sample))}
    counts = {d: toxicity.text_terms(t) for d, t, *_ in data}
    df = Counter(t for c in counts.values() for t in c)
    weights = {d: {t: (1 + np.log(n)) * (np.log((1 + len(data)) / (1 + df[t])) + 1) for t, n in c.items()} for d, c in counts.items()}
    norm = {d: np.sqrt(sum(x * x for x in w.values())) for d, w in weights.items()}
    for d, w in weights.items():
        plain = sorted((sum(x * weights[e].get(t, 0) for t, x in w.items()) / norm[d] / norm[e] for e in weights if e < 200), reverse=True)
        assert len(found[d]["neighbour_ids"]) == 15 and np.allclose(found[d]["cosines"], plain[:15], atol=0.02)
    assert found[200]["neighbour_ids"][0] == 3 and abs(found[200]["cosines"][0] - 1) < 1e-9
