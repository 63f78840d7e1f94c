import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestrata.llm import bytepair, packing, pieces, token_counts


def texts(seed, n=400):
    random.seed(seed)
    letters = "abcdefgh tion éèñ  \n\t.,'\"<>/s|[]INST012345▁☃漢字ß🎉\x00\x7f\ufeff\u0301"
    return ["", " ", "  a", "a ", "</s>[INST]", "<0x0A>", "<|endoftext|> x", "▁▁▁x", " " * 40, "th" * 60, "a\n b \n\n c", "don't  we'll"] + ["".join(random.choice(letters) for _ in range(random.randint(1, 80))) for _ in range(n)]


def test_pieces_as_the_library(piece_file):
    model, own = sentencepiece.SentencePieceProcessor(model_file=piece_file), pieces.encoder(piece_file)
    random.seed(5)
    glued = ["".join(model.id_to_piece(random.randint(259, 31999)).replace("▁", " ") for _ in range(random.randint(1, 9))) for _ in range(2000)]
    kept = pieces.TextDigests(piece_file)
    for t in texts(1, 2000) + glued:
        ids = model.encode(t)
        assert own.encode(t) == ids
        back = model.decode(ids)
        assert own.decode(ids) == back
        assert kept.of(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    for _ in range(300):  # any ids decode as in the library
        ids = [random.choice([random.randint(3, 258), random.randint(259, 31999), 1, 2]) for _ in range(6)]
        assert own.decode(ids) == model.decode(ids)


def test_piece_cache_is_bounded(piece_file, monkeypatch):
    kept = pieces.TextDigests(piece_file)
    kept.chunks.size = kept.parts.size = 5
    want = pieces.TextDigests(piece_file)
    for t in texts(2, 100):
        assert kept.of(t) == want.of(t)
        assert len(kept.chunks) <= 5 and len(kept.chunks.older) <= 5


def test_bytes_as_the_library(bytes_file):
    model = Tokenizer.from_file(bytes_file)
    own = bytepair.encoder(bytes_file)
    for t in with_added(texts(3, 1500)):
        encoded = model.encode(t, add_special_tokens=False)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == encoded.ids
        spans, at = [], 0
        for run, added in own.runs(t):
            first, end = own.spans(run) if added is None else (np.array([0]), np.array([len(run)]))
            spans += zip((first + at).tolist(), (end + at).tolist(), strict=True)
            at += len(run)
        assert spans == encoded.offsets
    assert np.frombuffer(own.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def with_added(made):
    """Texts, some with the string of an added token in them, more than once or cut short."""
    rng = random.Random(9)
    for t in made:
        for mark in rng.choice(((), (), ("<|endoftext|>",), ("<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof"))):
            at = rng.randint(0, len(t))
            t = t[:at] + mark + t[at:]
        yield t


def test_long_words_are_not_kept(bytes_file):
    own = bytepair.ByteEncoder(bytes_file)
    assert own.encode("a " + "bc" * 400 + " d") == own.ids("a " + "bc" * 400 + " d") and max(map(len, own.words)) < 300


def test_repacking_saves_and_stays_whole():
    rng = np.random.default_rng(4)
    lengths = np.concatenate((rng.integers(200, 700, 400), rng.integers(1, 300, 100)))
    plain = min(len(f(lengths, 1024)[2]) for f in (packing.best_fit_decreasing, packing.exact_fill_first))
    where, offset, used, bound, _ = packing.pack_lengths(lengths, 1024)
    assert bound <= len(used) <= plain
    check_packing([{"sequence_id": w, "offset": o, "length": n} for w, o, n in zip(where.tolist(), offset.tolist(), lengths.tolist(), strict=True)])
    assert np.bincount(where, lengths, len(used)).astype(int).tolist() == used.tolist() and used.max() <= 1024


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(bytes_file, rule):
    model = Tokenizer.from_file(bytes_file)
    own = bytepair.encoder(bytes_file)
    for t in with_added(texts(4, 300)):
        starts = token_counts.line_starts(t)
        assert starts.tolist() == [0] + [i + 1 for i, c in enumerate(t[:-1]) if c == "\n"]
        bounds, want = [*starts.tolist(), 1 << 60], [0] * len(starts)
        for a, b in model.encode(t, add_special_tokens=False).offsets:
            touched = [i for i in range(len(starts)) if bounds[i] < b and bounds[i + 1] > a]
            overlap = [min(b, bounds[i + 1]) - max(a, bounds[i]) for i in touched]
            want[touched[{"first": 0, "last": -1, "most": overlap.index(max(overlap))}[rule]]] += 1
        assert token_counts.attribute(own, t, starts, rule).tolist() == want


def test_token_counts_of_awkward_rows(spark, documents, awkward, bytes_file):
    got = token_counts.count_tokens(documents(awkward), bytes_file).collect()
    total = lambda i: sum(r["n_tokens"] for r in got if r["doc_id"] == i)
    assert total(1) == total(2) == 0 and total(5) == 2 * total(4) and total(6) == 4000 * 7 + 1
    assert token_counts.count_tokens(documents([]), bytes_file).count() == 0


def test_fields_are_sections(spark, bytes_file):
    df = spark.createDataFrame([(1, "one two", None, "three")], "doc_id long, a string, b string, c string")
    text, starts = token_counts.fields_as_sections(["a", "b", "c"])
    got = token_counts.count_tokens(df, bytes_file, text=text, starts=starts).collect()
    assert [(r["start"], r["length"]) for r in got] == [(0, 8), (8, 1), (9, 6)] and sum(r["n_tokens"] for r in got) == len(bytepair.encoder(bytes_file).encode("one two\n\nthree\n")) // 4


def packed_rows(df, bytes_file, **more):
    return packing.pack_documents(df, bytes_file, **more).collect()


def check_packing(rows, capacity=1024):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def test_packing_awkward_rows(spark, documents, awkward, bytes_file):
    rows = packed_rows(documents(awkward), bytes_file)
    check_packing(rows)
    own = bytepair.encoder(bytes_file)
    for i, t in awkward:
        ids = own.encode(t or "") + b"\x02\0\0\0"
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i})
        assert [(s, n) for _, s, n, _ in mine] == packing.cut(len(ids) // 4, 1024)
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in mine)
    assert len(rows) == sum(len(packing.cut(len(own.encode(t or "")) // 4 + 1, 1024)) for _, t in awkward)
    assert packed_rows(documents([]), bytes_file) == []


def test_sequences_hold_the_ids(spark, documents, bytes_file):
    packed = packing.pack_documents(documents([(i, f"text number {i} " * i) for i in range(60)]), bytes_file, with_ids=True)
    made = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4096 for r in made)


def test_every_piece_is_placed_once():
    random.seed(11)
    for capacity in (5, 64, 1024):
        for _ in range(60):
            lengths = np.array([random.randint(1, capacity) for _ in range(random.randint(1, 120))])
            for pack in (packing.best_fit_decreasing, packing.exact_fill_first):
                where, offset, used = pack(lengths, capacity)
                rows = [{"sequence_id": w, "offset": o, "length": n} for w, o, n in zip(where, offset, lengths, strict=True)]
                assert check_packing(rows, capacity) == len(used) and np.bincount(where, lengths).tolist() == used.tolist()


def test_exchange_meets_the_bound(spark):
    random.seed(8)
    lengths = [random.randint(1, 700) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    from lodestrata.storage import materialise

    rows = packing.pack(materialise(df, "test"), 1024, partition_size=100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)[0]
    alone = sum(len(packing.best_fit_decreasing(np.array(lengths[i : i + 100]), 1024)[2]) for i in range(0, 3000, 100))
    print(check_packing(rows), bound, alone)
    assert check_packing(rows) <= 1.005 * bound < alone


def test_bounds_are_below_best_packings():
    random.seed(9)

    def best(lengths, capacity):  # exact, by trying all places for the longest first
        lengths, found = sorted(lengths, reverse=True), [len(lengths)]

        def place(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(lengths):
                found[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= capacity:
                    bins[k] += lengths[i]
                    place(i + 1, bins)
                    bins[k] -= lengths[i]
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return found[0]

    for _ in range(150):
        lengths = [random.randint(1, 20) for _ in range(random.randint(1, 8))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)[0]
        exact = best(lengths, 20)
        assert -(-sum(lengths) // 20) <= bound <= exact <= len(packing.pack_lengths(np.array(lengths), 20)[2])
    assert packing.lower_bound(np.bincount([7] * 9, minlength=13), 12)[0] == 9
