import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def plain(rows):
    def leaf(r, more=0):
        return h(*map(framed, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for i, x in enumerate(langs):
        for at, r in enumerate(by[x]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold, siblings = leaf(r, int(changed)), []
            for tree, place in ((trees[x], at), (top, i)):
                for level in tree[:-1]:
                    other = place ^ 1
                    if other < len(level):
                        siblings.append(level[other])
                        fold = h(level[other], fold) if other < place else h(fold, level[other])
                    else:
                        fold = h(fold)
                    place >>= 1
            yield r[0], trees[x][0][at], trees[x][-1][0], top[-1][0], h(*siblings), fold, fold == top[-1][0]


def run(spark, rows, size=merkle.LEVELS, parts=3):
    made = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(str, map(tuple, merkle.manifest(made, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, size).collect())))


@pytest.mark.parametrize(("n", "size"), [(1, 12), (2, 1), (37, 12), (300, 1), (300, 3)])
def test_against_plain_trees(spark, n, size):
    rng = random.Random(n)
    make = lambda: (rng.choice([None, rng.randint(-99, 9999), 5]), rng.choice(["", None, "tï漢xt\x00'\" " * rng.randint(1, 30), "long " * 20000]), rng.choice(["en", "en", "en", "en", "de", "é", "", None]), rng.choice(["s", None, ""]), rng.choice([None, 3, 0]), "x", 1, "y")
    rows = [make() for _ in range(n)]
    rows += rows[: n // 9]  # repeated rows
    want = sorted(map(str, plain(rows)))
    assert run(spark, rows, size) == want


def test_one_language_many_blocks_and_no_rows(spark):
    rows = [(i, f"t{i}", "en", "s", i, "x", 1, "y") for i in range(129)]
    assert run(spark, rows, 3) == sorted(map(str, plain(rows)))
    assert run(spark, []) == []


def test_tampering_is_found_and_nothing_else(spark):
    rows = [(i, "text", "en", "s", i, "x", 1, "y") for i in range(200)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 77).collect():
        assert r["verified"] == (r["doc_id"] != 77)
