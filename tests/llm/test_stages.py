import random

import pytest

import corpus_pipeline


@pytest.mark.parametrize("labels", [[], [(99, 1, 1)], [(1, 1, 1)]])
def test_without_a_learned_model_nothing_is_rejected(spark, documents, awkward, tmp_path, labels):
    """No labels, none of these documents, or those of one class only."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, documents(awkward), str(tmp_path)).count() == len(awkward)


def test_whole_run_against_plain_steps(spark, tmp_path, bytes_file):
    """Each stage's rows from those of the one before it: scores of the learned models, near copies by comparing all pairs, packed ids."""
    import zlib

    from test_classifiers import LABELS, corpus
    from test_similar import plain_survivors

    from lodestrata.llm import bytepair, packing, quality, toxicity

    docs, labels = corpus(160)
    rng = random.Random(4)
    for i, text in docs[:40]:
        words = text.split()
        if len(words) > 60:
            words[rng.randrange(len(words))] = "edited"
            docs.append((1000 + i, " ".join(words)))
    docs += [(2000, ""), (2001, None), (2002, docs[3][1])]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    known = spark.createDataFrame(labels, LABELS)
    known.write.parquet(f"{folder}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(frame(docs), known).collect()}
    left = [(i, t) for i, t in docs if scores[i] < 0.5]
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(frame(left), known).collect()}
    left = [(i, t) for i, t in left if scores[i] >= 0.5]
    want = plain_survivors(left)
    assert len(docs) > len(left) > len(want) > 40
    own, pieces = bytepair.encoder(bytes_file), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert sorted(pieces) == [i for i, _ in want]
    for i, t in want:
        ids = own.encode(t or "") + b"\x02\0\0\0"
        assert sorted(pieces[i]) == [(s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for s, n in packing.cut(len(ids) // 4, 1024)]
