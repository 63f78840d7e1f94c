import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import simhash, similar


def plain_shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def alike(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def plain_survivors(rows):
    """(doc_id, text) that stay of rows with ids, by comparing all pairs."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min((rows[i] for i in range(len(rows)) if root[i] == r), key=lambda x: x[0]) for r in set(root))


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = rng.choice("abcdefghij") * rng.randint(1, 9)
    return out


def corpus(seed):
    rng, made = random.Random(seed), []
    common = [rng.choice(("in", "of", "the", "law", "use")) for _ in range(40)]
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 120))] + common[: rng.choice((0, 0, 20, 40))]
        made.append(base)
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            made.append(edited(rng, rng.choice(made[-3:]), rng.choice((0, 0.01, 0.02, 0.04, 0.05))))
    rng.shuffle(made)
    return [(i, " ".join(w)) for i, w in enumerate(made)]


@pytest.mark.parametrize(("limit", "frequent", "node"), [(1 << 22, 1 << 17, 8192), (300, 5, 4)])
def test_every_similar_pair_is_found(spark, documents, monkeypatch, limit, frequent, node):
    monkeypatch.setattr(similar, "NODE_SHINGLES", limit)
    monkeypatch.setattr(similar, "NODE_LIMIT", node)
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rows = corpus(7)
    want = plain_survivors(rows)
    assert len(rows) - len(want) > 30
    got = similar.deduplicate(documents(rows))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want and got.columns == documents([]).columns


def test_pipeline_stage_drops_edited_copies(spark, documents):
    """One word in fifty replaced: similarity 0.8 and more, but over four bits of SimHash apart."""
    rng = random.Random(1)
    rows = []
    for i in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        other = list(base)
        for at in (40, 80, 120):
            other[at] = "edited"
        assert alike(plain_shingles(" ".join(base)), plain_shingles(" ".join(other)))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()) == list(range(0, 20, 2))


def test_threshold_is_exact(spark, documents):
    """Two texts of 9 shingles, 8 of them shared, have 8/10; with 7 shared 7/11."""
    base = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "z"])), (3, " ".join(f"b{i}" for i in range(13))), (4, " ".join([*(f"b{i}" for i in range(11)), "y", "z"]))]
    assert sorted(r["doc_id"] for r in similar.deduplicate(documents(rows)).collect()) == [1, 3, 4]
    assert [similar.prefix_length(n) for n in (0, 1, 4, 5, 9, 10)] == [0, 1, 1, 2, 2, 3]


def test_awkward_rows(spark, documents, awkward):
    kept = similar.deduplicate(documents(awkward)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 4, 6, 7, 8] and list(kept[0].asDict()) == documents([]).columns
    assert similar.deduplicate(documents([])).count() == 0


def test_texts_that_share_an_id_are_judged_apart(spark, documents):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (2, long), (2, "something else that nobody copied at all"), (3, "one"), (3, "one"), (3, "two")]
    assert sorted((r["doc_id"], r["text"][:9]) for r in similar.deduplicate(documents(rows)).collect()) == [(1, long[:9]), (2, "something"), (3, "one"), (3, "two")]


def test_nodes_link_what_is_near(spark, monkeypatch):
    """Nodes of all sizes, with equal and hot fingerprints and rows over several batches, give the components of all near pairs."""
    monkeypatch.setattr(similar, "NODE_LIMIT", 20)
    rng = random.Random(3)
    rows, links = [], []
    for node in range(30):
        base = rng.getrandbits(64)
        own = [(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 3, 14))))) if rng.random() < 0.6 else rng.getrandbits(64) for _ in range(rng.choice((1, 2, 5, 15, 90)))]
        named = [(node, simhash._signed(f), node * 1000 + i, f) for i, f in enumerate(own)]
        rows += named
        links += [(a[2], b[2]) for i, a in enumerate(named) for b in named[:i] if (a[3] ^ b[3]).bit_count() <= similar.DISTANCE]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    found = similar._searched(spark.createDataFrame([r[:3] for r in rows], "node long, fp long, name long"), 20).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    over: dict = {}
    for r in found:
        if r["node"] is not None:
            over.setdefault(r["node"], []).append((r["u"], r["v"]))
    got = [(r["u"], r["v"]) for r in found if r["node"] is None]
    for own in over.values():
        got += [(a[1], b[1]) for i, a in enumerate(own) for b in own[:i] if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= similar.DISTANCE]
    assert over and parts(got) == parts(links)


def test_near_copies_give_links_in_proportion(spark, documents, monkeypatch):
    """Near copies are in many nodes together: each node and each task returns a forest, and links of all tasks are merged before star rounds."""
    rng = random.Random(4)
    node = spark.createDataFrame([(n, b, n * 100 + b) for n in range(50) for b in range(40)], "node long, fp long, name long")
    found = [(r["u"], r["v"]) for r in similar._searched(node, 8192).collect()]
    assert sorted(found) == [(n * 100 + b, n * 100) for n in range(50) for b in range(1, 40)]
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(300)]
    given = []
    reach = similar.smallest_reachable
    monkeypatch.setattr(similar, "smallest_reachable", lambda links: given.append(links.count()) or reach(links))
    assert similar._blocks(marked(documents, rows)).count() == 299
    assert given[0] <= 4 * 299  # four tasks in tests


def test_forests_are_held_and_given_out_in_parts(monkeypatch):
    monkeypatch.setattr(similar, "LINKS_HELD", 20)
    rng = np.random.default_rng(2)
    links, held, got = rng.integers(0, 300, (2, 400)), similar._Forest(), []
    for at in range(0, 400, 8):
        held.add(*links[:, at : at + 8])
        got.append(held.excess())
    got.append(held.rest())
    assert sum(len(x[0]) > 0 for x in got) > 5 and len(held.rest()[0]) == 0
    assert parts([(u, v) for x in got for u, v in x.T.tolist()]) == parts([(u, v) for u, v in links.T.tolist() if u != v])


@pytest.mark.parametrize("small", [False, True])
def test_large_nodes_are_factored_once_more(spark, documents, monkeypatch, small):
    """400 unlike texts and ten pairs of near copies in one node: chunks of two would send each row 210 times, the other masks do 92 times."""
    monkeypatch.setattr(similar, "NODE_LIMIT", 4)
    rng = random.Random(6)
    n = 8 if small else 120
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(n))) for i in range(400)]
    rows += [(1000 + i, " ".join([*(f"t{i}x{j}" for j in range(n)), *(["more"] if small else [])]).replace(f"t{i}x50 ", "new ")) for i in range(0, 400, 40)]
    rng.shuffle(rows)
    deal, search, sent = similar._dealt, similar._searched, []
    monkeypatch.setattr(similar, "_dealt", lambda classes: deal(classes).where("node < 0" if small else "node >= 0").withColumn("node", F.lit(-1 if small else 0).cast("long")).dropDuplicates(["name"]))
    monkeypatch.setattr(similar, "_searched", lambda nodes, limit: sent.append(nodes.count()) or search(nodes, limit))
    found = similar._blocks(marked(documents, rows)).collect()
    names = {r["doc_id"]: r["name"] for r in marked(documents, rows).collect()}
    assert parts([(r["u"], r["v"]) for r in found]) == parts([(names[i], names[1000 + i]) for i in range(0, 400, 40)])
    assert sent[0] == 410 and sum(sent[1:]) < 100 * 410 + (60 * 410 if small else 0)


def test_trees_join_what_all_pairs_join():
    """Fingerprints in families that are far apart, near copies and random ones, at sizes about those of leaves and levels."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 49, 128, 129, 700):
        bases = rng.integers(0, 2**63, (5, 3)).astype(np.uint64)
        fps = bases[rng.integers(0, 5, n)]
        for _ in range(14):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)) * (rng.random((n, 3)) < 0.9)
        fps[::7] = rng.integers(0, 2**63, fps[::7].shape).astype(np.uint64)
        near = (np.cumsum(np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int), axis=2) <= similar.LIMITS).all(axis=2)
        got = similar._roots(fps, similar.LIMITS)
        want = parts([*((i, i) for i in range(n)), *zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)])
        assert parts(list(enumerate(got.tolist()))) == want


def parts(links):
    root: dict = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    groups: dict = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    text = "one two  three\tone\ntwo two " + "x" * 50 + " one"
    hashes = similar.word_hashes(text.encode()).tolist()
    assert len(hashes) == 8 and len(set(hashes)) == 4 and hashes[0] == hashes[3] == hashes[7] and hashes[1] == hashes[4] == hashes[5]
    monkeypatch.setattr(similar, "AT_ONCE", 12)
    assert similar.word_hashes(text.encode()).tolist() == hashes and len(similar.word_hashes(b" \n ")) == 0 == len(similar.word_hashes(b""))


def marked(documents, rows):
    own = documents(rows).select("doc_id", simhash.text_hash(F.col("text")).alias("h"), "text")
    return similar._marked(own, 5)


def test_texts_of_shared_passages_make_no_blocks(spark, documents):
    """Unlike texts, each of twelve of sixty passages: every shingle is in many of them, yet nothing is compared exactly."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}w{j}" for j in range(10)) for i in range(60)]
    rows = [(i, " ".join(rng.sample(passages, 12))) for i in range(400)]
    assert len(plain_survivors(rows)) == 400
    assert similar._blocks(marked(documents, rows)).count() == 0


@pytest.mark.parametrize("limit", [8192, 3])
def test_blocks_are_those_of_fingerprints_that_share_a_mask(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(similar, "NODE_LIMIT", limit)
    rows = corpus(8) + [(1000 + i, " ".join(f"s{i // 2}x{j}" for j in range(8 + i % 2))) for i in range(20)]
    sets = {r["name"]: (r["size"], np.frombuffer(bytes(r["bits"]), np.uint64)) for r in marked(documents, rows).collect()}
    top, below = similar.SIMILAR
    links = []
    for small, limits, inside in ((False, similar.LIMITS, lambda n: n >= similar.SMALL), (True, similar.SMALL_LIMITS, lambda n: n * top <= (similar.SMALL - 1) * below)):
        own = [(name, fp, set(similar.upper_nodes(fp[None, :], small)[0].tolist())) for name, (n, fp) in sets.items() if inside(n)]
        for i, (u, f, m) in enumerate(own):
            links += [(u, v) for v, g, n in own[:i] if m & n and all(sum(int(x ^ y).bit_count() for x, y in zip(f[: w + 1], g[: w + 1], strict=True)) <= limits[w] for w in range(3))]
    assert len(links) > 30
    assert parts([(r["u"], r["v"]) for r in similar._blocks(marked(documents, rows)).collect()]) == parts(links)


def test_fingerprints_are_majorities_of_all_words():
    rng = np.random.default_rng(1)
    for n in (1, 2, 14, 15, 255, 256, 700):
        made = np.unique(rng.integers(-(2**62), 2**62, n))
        hashes, got = similar._mixed(made.view(np.uint64)[:, None] + similar._STEPS), similar.fingerprint(made)
        for w in range(similar.WORDS):
            counts = [sum(int(h) >> b & 1 for h in hashes[:, w]) for b in range(64)]
            assert [int(got[w]) >> b & 1 for b in range(64)] == [int(2 * c + (int(hashes[0, w]) >> b & 1) > n) for b, c in enumerate(counts)]
    assert not similar.fingerprint(np.empty(0, np.int64)).any()
