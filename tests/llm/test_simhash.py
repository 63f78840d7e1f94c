import random
import re

import numpy as np
import pytest
import xxhash

from lodestrata.llm import components, simhash, similar


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, distance=4):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    kinds = sorted(set(fps))
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= distance and root(a) != root(b):
                parent[root(b)] = root(a)
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for f in fps]


def near_hashes(n, seed):
    random.seed(seed)
    out = []
    for _ in range(n):
        base = random.choice(out) if out and random.random() < 0.6 else random.getrandbits(64)
        for _ in range(random.randint(0, 6)):
            base ^= 1 << random.randrange(64)
        out.append(base)
    return out


def test_fingerprints():
    for t in (None, "", " \t\x0b", "One", "one TWO three", "É A b c d É", "a\x00b   c d e", "x " * 40_000, "the cat sat on the mat and the cat sat on the mat"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_gray_rank_orders_the_gray_code():
    codes = np.array([i ^ i >> 1 for i in range(4096)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(4096))


@pytest.mark.parametrize("n", [2, 60, 700])
def test_forest_and_index(n):
    fps = sorted(set(near_hashes(n, n)))
    roots = simhash.forest(np.array(fps, np.uint64), 4)
    want = plain_components(fps, range(len(fps)))
    groups = {}
    for r, w in zip(roots.tolist(), want, strict=True):
        assert groups.setdefault(r, w) == w
    assert len(groups) == len(set(want))
    order = np.argsort(simhash.gray_rank(np.array(fps, np.uint64)))
    own = np.array(fps, np.uint64)[order]
    a, b = simhash.GrayIndex(own).near(own, 4)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(len(own)) for j in range(len(own)) if (int(own[i]) ^ int(own[j])).bit_count() <= 4]


@pytest.mark.parametrize("limit", [8192, 40, 6])
def test_links_at_every_depth(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    fps = sorted(set(near_hashes(300, 5)) | {0x0F0F << 20 ^ sum(1 << b for b in random.sample(range(64), 2)) for _ in range(150)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    reached = {r["u"]: r["v"] for r in components.smallest_reachable(simhash.links(df)).collect()}
    found, want = {}, {}
    for f, c in zip(fps, plain_components(fps, range(len(fps))), strict=True):
        found.setdefault(reached.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    reached = {r["u"]: r["v"] for r in components.smallest_reachable(df).collect()}
    assert reached == {i: 0 for i in range(1, 201)} | {501: 500}


def test_awkward_documents(spark, documents, awkward):
    rows = awkward + [(20, "one two three four five six seven eight nine ten " * 30), (21, "one two three four five six seven eight nine ten " * 30 + "x"), (None, None)]
    got = simhash.near_duplicates(documents(rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((i is None, i or 0, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows]), strict=True)), key=str)
    from pyspark.sql import functions as F

    marked = simhash.near_duplicates(documents(rows)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("h"), "component_id").collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["h"], r["component_id"]) for r in marked), key=str) == want and len(got) == len(rows)
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_of_each_group_stays(spark, documents, awkward):
    kept = simhash.deduplicate(documents(awkward)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 4, 6, 7, 8] and list(kept[0].asDict()) == documents([]).columns
    assert simhash.deduplicate(documents([])).count() == 0


def test_ids_that_occur_with_several_texts_lose_none(spark):
    """Rows are judged by their own texts, and no name of a column gets in the way."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(3, "b"), (5, "a"), (5, "b"), (9, "a"), (7, "c"), (7, "c")]
    df = spark.createDataFrame([(i, text[k], i, k, 0.5) for i, k in rows], "doc_id long, text string, gone long, h string, fp double")
    for way in (simhash.deduplicate, similar.deduplicate):
        kept = way(df)
        assert sorted((r["doc_id"], r["h"]) for r in kept.collect()) == [(3, "b"), (5, "a"), (7, "c")] and kept.columns == df.columns
