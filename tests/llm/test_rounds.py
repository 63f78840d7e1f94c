import logging
import random

from lodestrata.llm import packing
from lodestrata.storage import materialise


def test_rounds_go_on_while_they_save(spark, monkeypatch, caplog):
    rounds, real = [], packing._pack_round
    monkeypatch.setattr(packing, "_pack_round", lambda *a: (rounds.append(a[2]), real(*a))[1])
    rng = random.Random(3)
    rows = [(i, 0, rng.randint(12, 70)) for i in range(600)]
    with caplog.at_level(logging.INFO, logger=packing.__name__):
        out = packing.pack(materialise(spark.createDataFrame(rows, "doc_id long, piece int, length long"), "pieces"), 100, 6).collect()
    assert max(rounds) > 6
    fills = {}
    for r in out:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in out) == rows and max(fills.values()) <= 100
    assert f"{len(fills)} sequences of 600 pieces; no packing has fewer than" in caplog.text
