import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_tokens import texts
from tokenizers import Tokenizer

from lodestrata.llm import speculative

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def own():
    return speculative.encoder(FILE)


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return ids, back, (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def awkward_texts(own):
    rng = random.Random(8)
    glued = [t.removesuffix("</w>") for t in own.token]
    yield from ("</w>", "a</w> b", "<|endoftext|>", "x<|startoftext|>y<|endoftext|><|endoftext|", "<|ENDOFTEXT|>", "aaaaaaaaaa" * 30, "ha" * 99, "ΑΣ Σ", "İX", "é ́e", "\x85a\xa0b\x1cc")
    yield from texts(6, 1500)
    for _ in range(1500):
        yield "".join(rng.choice(glued) for _ in range(rng.randint(1, 6)))
        yield "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 70)))
    for c in range(1, 0x3000):
        yield "X" + chr(c) + "y1"


def test_ids_and_texts_as_the_library(library, own):
    every = list(awkward_texts(own))
    kept = speculative.TextDigests(FILE)
    got = [d for part in speculative.slices(every, 5000) for d in kept.of(part)]
    for t, digest in zip(every, got, strict=True):
        ids, back, want = digests(library, t)
        assert own.encode(t) == ids and own.decode(ids) == back and digest == want, t


def test_failing_words_only_are_merged(own):
    proposed, merged = own.proposed, own.merged
    words = ["".join(random.Random(i).choices("etaoinshrdlu", k=9)) for i in range(2000)]
    found = own.encode_words(words)
    again = own.merged - merged
    assert own.proposed - proposed == 2000 and 0 < again < 2000
    symbols = [own.inner[[ord(c) for c in w]] for w in words]
    for w, s, ids in zip(words, symbols, found, strict=True):
        s[-1] = own.final[ord(w[-1])]
        assert own.merge(s.tolist()) == ids


def test_pair_checks_against_merging(own):
    """Any two whole tokens stand side by side exactly where merging their letters gives them back."""
    rng = np.random.default_rng(2)
    final = np.array([t.endswith("</w>") for t in own.token])
    left, right = rng.choice(np.flatnonzero(own.whole & ~final), 4000), rng.choice(np.flatnonzero(own.whole), 4000)
    left, right = np.concatenate((left, left)), np.concatenate((right, left))

    def letters(t):
        return letters(own.left[t]) + letters(own.right[t]) if own.rank[t] else [int(t)]

    apart = own.apart(left, right)
    assert apart.any() and not apart.all()
    for a, b, fine in zip(left.tolist(), right.tolist(), apart.tolist(), strict=True):
        assert (own.merge(letters(a) + letters(b)) == [a, b]) == fine


def test_cache_is_bounded():
    kept, want = speculative.TextDigests(FILE), speculative.TextDigests(FILE)
    kept.kept.size = 5
    for t in [*texts(2, 100), "b" * 999]:
        assert kept.of([t]) == want.of([t])
        assert len(kept.kept) <= 5 and len(kept.kept.older) <= 5
    assert max(map(len, want.kept)) <= speculative.LONGEST


def test_documents(spark, documents, awkward, library):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in speculative.digest_documents(documents(awkward), FILE).collect()}
    assert rows == {(i, *digests(library, t or "")[2]) for i, t in awkward}
    for r in speculative.encode_documents(documents(awkward), FILE).collect():
        t = dict(awkward)[r["doc_id"]] or ""
        assert r["ids"] == digests(library, t)[0] and r["decoded"] == digests(library, t)[1]
    assert speculative.digest_documents(documents([]), FILE).count() == 0


def test_the_query_on_a_whole_table(spark, small, library):
    from lodestrata.llm import queries

    want = sorted((r["doc_id"], *digests(library, r["text"] or "")[2]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op12_speculative_bpe(spark, small).collect())) == want
