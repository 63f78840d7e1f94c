import random
import re
from collections import Counter, defaultdict

import pytest

from lodestrata.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, p double"


def plain(rows, min_docs, prior=5, scale=10**9, top=50):
    occurrences, held = defaultdict(Counter), defaultdict(Counter)
    groups = {(r[2] or "", r[3] or "") for r in rows}
    for _, text, lang, source, *_ in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        occurrences[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted(s for found, s in groups if found == lang)
        whole = sum((occurrences[lang, s] for s in sources), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + prior) // (total + prior * len(kept)) for t in kept}  # noqa: B023

        q, p = shares(whole), {s: shares(occurrences[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if occurrences[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("al", "Be", "ça", "漢", "do", "E") for b in ("", "x", "ö", "RY", "1x", "_z")]
    for i in range(n):
        text = rng.choice([" ", "\n", ", "]).join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 40)))
        yield (rng.choice([None, i, 7]), rng.choice([text, text, text, None, "", " \t"]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "b", "c", None]), "x", 1, 2.0)
    yield (1, "of no other", "fr", "alone", "x", 1, 2.0)
    yield (2, "word " * 3000, "en", "long", "x", 1, 2.0)
    yield (3, "", "en", "silent", "x", 1, 2.0)


def found(spark, rows, min_docs, **more):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs, **more).collect())


@pytest.mark.parametrize("min_docs", [1, 3, 30])
def test_against_plain_counting(spark, min_docs):
    rows = list(corpus(min_docs, 300))
    want = plain(rows, min_docs)
    assert found(spark, rows, min_docs) == want and {r[2] for r in want} == {"pair", "term"}


def test_a_full_sketch_lets_through_more_and_nothing_changes(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["".join(rng.choices(letters, k=9)) for _ in range(60_000)]
    rows = [(i, " ".join(rng.sample(rare, 1500) + rng.choices(["often", "seen", "here"], k=9)), "en", f"s{i % 7}", "x", 1, 2.0) for i in range(200)]
    want = plain(rows, 9)
    assert found(spark, rows, 9, width=divergence.BLOCK) == want == found(spark, rows, 9)


def test_the_sketch_never_underestimates(spark):
    rows = spark.createDataFrame([(i, f"always word{i % 50}", "en", "s", "x", 1, 2.0) for i in range(400)], SCHEMA).repartition(7)
    raw = divergence._rows(rows, "lang", "source", "text")
    bits = divergence.document_sketch(raw, 8)
    kept = {bytes(r["term"]).decode(): (r["n"], r["docs"]) for r in divergence.surviving_counts(raw, bits).collect()}
    assert kept["always"] == (400, 400) and kept["word"] == (400, 400)
    none = divergence.surviving_counts(raw, divergence.document_sketch(raw, 200)).collect()
    assert {bytes(r["term"]).decode() for r in none} == {"always", "word"}


def test_tables_without_terms(spark):
    assert found(spark, [], 30) == []
    assert found(spark, [(1, "a", "en", "x", "", 1, 1.0), (2, None, "en", "y", "", 1, 1.0), (3, "b", None, None, "", 1, 1.0)], 30) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_beyond_longs(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(4 * 10**12), F.lit(9 * 10**12), F.lit(10**6), 5, 10**9).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 5 * 10**6)
