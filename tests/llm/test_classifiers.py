import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality, toxicity


def corpus(n=400, seed=6):
    random.seed(seed)
    syllables = ["tion", "ing", "er", "an", "the", "re", "on", "es", "al", "st"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(random.randint(8, 200))]
        junk, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(2 + len(words) // 30):
                words[random.randrange(len(words))] = random.choice(["zounds", "grobo", "grobian", "groboid"])
        text = " ".join(words) + "."
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def outcome(spark, scores, labels, column):
    rows = scores.join(spark.createDataFrame(labels, LABELS), "doc_id").where("held_out").collect()
    return np.mean([r["predicted"] == r[column] for r in rows]), rows


def test_quality_on_held_out(spark, documents):
    docs, labels = corpus()
    right, rows = outcome(spark, quality.quality_scores(documents(docs), spark.createDataFrame(labels, LABELS)), labels, "quality")
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in rows) and 90 < len(rows) < 180


def test_toxicity_on_held_out(spark, documents):
    docs, labels = corpus()
    right, rows = outcome(spark, toxicity.toxicity_scores(documents(docs), spark.createDataFrame(labels, LABELS)), labels, "toxic")
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_awkward_rows_and_labels(spark, documents, awkward, scores):
    docs, labels = corpus(120)
    docs = [(i + 100, t) for i, t in docs] + awkward
    labels = [(i + 100, q, t) for i, q, t in labels] + [(100, None, None), (101, 7, 7), (None, 1, 1), (102, 0, 1), (102, 0, 1)]
    labels = spark.createDataFrame([(*r, "x", 0.5) for r in labels], LABELS + ", text string, label double")
    got = scores(documents(docs), labels).collect()
    assert len(got) == len(docs) and all(r["score"] is not None and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)
    assert scores(documents([]), labels).count() == 0
    assert {r["score"] for r in scores(documents(docs), labels.limit(0)).collect()} == {0.5}
    one = labels.where("quality = 1 and toxic = 1")
    assert {r["score"] for r in scores(documents(docs), one).collect()} == {1.0}


def test_labels_of_the_held_out_fold_teach_nothing(spark, documents):
    docs, labels = corpus(200)
    from zlib import crc32

    for scores, folds, out in ((quality.quality_scores, 3, 1), (toxicity.toxicity_scores, 5, 0)):
        flipped = [(i, 1 - q, 1 - t) if crc32(str(i).encode()) % folds == out else (i, q, t) for i, q, t in labels]
        a, b = ({r["doc_id"]: round(r["score"], 9) for r in scores(documents(docs), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
        assert a == b


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    spread = rng.standard_normal((d, d)) / 4 + np.eye(d)
    cov = spread @ spread.T
    lower = np.linalg.cholesky(cov)
    m = [np.zeros(d), np.ones(d)]
    model = quality.Discriminant(np.ones(d), m, [np.linalg.inv(lower), np.eye(d)], [2 * float(np.log(np.diag(lower)).sum()), 0.0], 0.3)
    x = rng.standard_normal((5, d))
    density = lambda v, mean, c: -0.5 * ((v - mean) @ np.linalg.inv(c) @ (v - mean)) - 0.5 * np.linalg.slogdet(c)[1]
    assert np.allclose(model.difference(x), [density(v, m[1], np.eye(d)) - density(v, m[0], cov) + 0.3 for v in x])


def plain_kneser_ney(own, discount):
    """(letter ratios by gram, history ratios) by dictionaries of strings; own: each class's counts of grams."""
    grams = set(own[0]) | set(own[1])
    parts = {g[i:] for g in grams for i in range(len(g))}  # all strings seen, led by any letter or none
    after = Counter(g[1:] for g in parts if len(g) > 1)

    def backoff(g):
        of_history = {s: n for s, n in after.items() if s and s[:-1] == g[:-1] and len(s) == len(g)}
        total = sum(of_history.values())
        if len(g) == 1:
            return of_history[g] / total
        return (max(of_history[g] - discount, 0) + discount * len(of_history) * backoff(g[1:])) / total

    def own_of(c, h):
        return {g: n for g, n in own[c].items() if g[:-1] == h and n}

    def left(c, h):
        counts = own_of(c, h)
        return discount * len(counts) / sum(counts.values()) if counts else 1.0

    letters, histories = {}, {}
    for g in grams:
        h = g[:-1]
        p = [left(c, h) * backoff(g[1:]) + max(own[c].get(g, 0) - discount, 0) / (sum(own_of(c, h).values()) or 1) for c in (0, 1)]
        letters[g], histories[h] = math.log(p[1] / p[0]), math.log(left(1, h) / left(0, h))
    return letters, histories, backoff


def test_models_are_kneser_ney_over_all_counts(spark):
    """The arrays hold what dictionaries of strings give, with what was seen once, at the settings of the query."""
    rng = random.Random(2)
    texts = [(rng.randrange(2), " ".join("".join(rng.choice("aab\u00e9\U00010400") for _ in range(rng.randint(1, 12))) for _ in range(12))) for _ in range(6)]
    counts = toxicity.count_letters(spark.createDataFrame(texts, "label int, text string"))
    own = [{r["gram"]: r["n"] for r in counts.collect() if r["label"] == c} for c in (0, 1)]
    assert sum(n == 1 for n in own[0].values()) > 50
    letters, histories, backoff = plain_kneser_ney(own, toxicity.DISCOUNT)
    single = sorted({g[-1] for g in letters})
    assert abs(sum(backoff(c) for c in single) - 1) < 1e-9
    models = toxicity.estimate(counts)
    assert len(models.letters[0]) == len(letters) and len(models.histories[0]) == len(histories)
    words = ["ab", "aabba", "b\u00e9a\U00010400ab", "zz", "abz", "a" * 90, toxicity.words_of(texts[0][1])[0]]
    want = [sum(letters.get(g, histories.get(g[:-1], 0.0)) for g in toxicity.grams_of(w)) for w in words]
    assert models.ratios(words) == pytest.approx(want, abs=1e-4)
    assert models.features(["ab zz", "a" * 90, None])[:, 0] == pytest.approx([(want[0] + want[3]) / 2, want[5], 0], abs=1e-4) and "a" * 90 not in models.words


def test_rows_of_one_id_each_teach(spark, documents):
    docs, labels = corpus(150)
    twice = docs + [(i, t + " and other words") for i, t in docs[:20]]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(documents(x), spark.createDataFrame(labels, LABELS)).collect()) for x in (twice, twice[::-1])]
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]] and [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], abs=1e-6)


def test_fold_is_crc32(spark):
    from zlib import crc32

    got = spark.range(50).select(quality.fold(F.col("id"), 5)).collect()
    assert [r[0] for r in got] == [crc32(str(i).encode()) % 5 for i in range(50)]
