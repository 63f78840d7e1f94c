"""Merkle manifest of a table: a tree for each language, one over their roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Nodes of a tree are in order; every two of one level become the SHA-256 of
their digests as hexadecimal text, a lone last one that of its own, until one is left.

A tree is computed in aligned blocks of ``2 ** LEVELS`` nodes, each an Arrow table in one task. There DuckDB makes the
levels (``string_agg`` in order of place, ``sha256``); blocks' roots are the nodes of the next tier, which is computed
in the same way, so tiers are few and no task or driver holds a tree. Going down again, each block is met by its own
outer proof, and DuckDB appends siblings and folds leaves level by level, for all rows of the block at once.

Places in order are found without one task for a tree: digests are stored in ranges of (tree, key), numbered within a
range, and counts of the ranges before are added.

Defined cases: rows of one id are ordered by their leaves, null ids come first; a null language is a tree of its own, the
first. A tree of one leaf has this leaf as root. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.storage import materialise

#: Levels of a block: 4,096 nodes.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, tree, leaf, and the leaf after one was added to ``n_chars`` where ``tampered`` holds; stored, so that texts are read once."""
    field = lambda changed: digest(*(framed(F.col(c) + 1 if changed and c == "n_chars" else F.col(c)) for c in FIELDS))
    # a name that keeps nulls first and UTF-8 order
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = docs.select("doc_id", tree.alias("tree"), field(False).alias("digest"), F.when(tampered, field(True)).alias("other"))
    return materialise(rows.select("doc_id", "tree", "digest", F.coalesce("other", "digest").alias("start")), "leaves")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``place`` (from 0) in their tree, by these columns, and ``nodes``, the number of the tree's rows."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialise(ranged.withColumn("__n", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("tree", "__range").agg(F.min("__n").alias("__first"), F.count("*").alias("__rows"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__rows").over(by_tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "__range", "__first", before.alias("__before"), F.sum("__rows").over(by_tree).alias("nodes"))
    met = ranged.join(offsets, ["tree", "__range"])
    return met.withColumn("place", F.col("__n") - F.col("__first") + F.col("__before")).drop("__n", "__range", "__first", "__before")


@lru_cache(maxsize=1)
def _engine():
    """A worker's own DuckDB: in memory, one thread."""
    import duckdb

    found = duckdb.connect()
    found.execute("SET threads = 1")
    return found


def _query(sql: str, **tables: pa.Table) -> pa.Table:
    con = _engine()
    for name, rows in tables.items():
        con.register(name, rows)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def _levels(size: int, block: pa.Table) -> list[pa.Table]:
    """(place, digest) of each level of a block, the lowest first."""
    nodes = block["nodes"][0].as_py()
    height = min(size, (nodes - 1).bit_length())
    found = [block.select(["place", "digest"])]
    for _ in range(height):
        found.append(_query("SELECT place // 2 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM below GROUP BY place // 2", below=found[-1]))
    return found


def _bound(work: Callable, size: int) -> Callable:
    """The block's work with its number of levels, as a function of the tables alone."""
    if work is _root:
        return lambda block: work(size, block)
    return lambda block, outer: work(size, block, outer)


_ROOTS = "tree string, place long, nodes long, digest string"


def _root(size: int, block: pa.Table) -> pa.Table:
    top = _levels(size, block)[-1]
    nodes = (block["nodes"][0].as_py() + (1 << size) - 1) >> size
    return pa.table({"tree": block["tree"][:1], "place": pa.array([block["place"][0].as_py() >> size], pa.int64()), "nodes": pa.array([nodes], pa.int64()), "digest": top["digest"].cast(pa.string())})


def _siblings(size: int, block: pa.Table) -> pa.Table:
    """The block's rows with ``path``, their siblings in it from below: ``l`` and ``r`` tell the side, a lone node's is empty."""
    levels = _levels(size, block)
    rows = block.append_column("path", pa.array([[]] * block.num_rows, pa.list_(pa.string())))
    for i, level in enumerate(levels[:-1]):
        rows = _query(f"""
            SELECT b.* REPLACE (list_append(b.path, CASE WHEN s.place IS NULL THEN '' WHEN s.place < b.place >> {i} THEN 'l' || s.digest ELSE 'r' || s.digest END) AS path)
            FROM rows_ AS b LEFT JOIN level_ AS s ON s.place = xor(b.place >> {i}, 1)""", rows_=rows, level_=level)
    return rows


def _strings(rows: pa.Table) -> pa.Table:
    return rows.cast(pa.schema([(f.name, pa.list_(pa.string()) if pa.types.is_list(f.type) or pa.types.is_large_list(f.type) else pa.string() if pa.types.is_large_string(f.type) else f.type) for f in rows.schema]))


def _roots(size: int, nodes: DataFrame) -> DataFrame:
    """Roots of the blocks of (tree, place, nodes, digest), as nodes of the next tier; stored."""
    block = nodes.select("tree", "place", "nodes", "digest", F.shiftright("place", size).alias("block"))
    return materialise(block.groupBy("tree", "block").applyInArrow(_bound(_root, size), _ROOTS), "roots")


def _tiers(size: int, nodes: DataFrame) -> list[DataFrame]:
    """Nodes of every tier, the lowest first; those of the last are the trees' roots."""
    tiers = [nodes]
    while tiers[-1].where("nodes > 1").take(1):
        tiers.append(_roots(size, tiers[-1]))
    return tiers


def _paths(size: int, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, path) for the blocks of the lowest tier: siblings from the block's root up. ``above``: (tree, path) of the trees' roots."""
    outer = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for nodes in reversed(tiers[1:-1]):
        outer = materialise(_met(size, nodes, outer, _outer_path, "tree string, block long, path array<string>"), "paths")
    return outer


def _met(size: int, nodes: DataFrame, outer: DataFrame, work, schema: str) -> DataFrame:
    """Each block of nodes with its outer proof, in one task."""
    left = nodes.withColumn("block", F.shiftright("place", size)).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "block")).applyInArrow(_bound(work, size), schema)


def _outer_path(size: int, block: pa.Table, outer: pa.Table) -> pa.Table:
    rows, rest = _siblings(size, block), outer["path"][0].as_py()
    return pa.table({"tree": rows["tree"], "block": rows["place"], "path": pa.array([p + rest for p in rows["path"].to_pylist()], pa.list_(pa.string()))})


def _proof(size: int, block: pa.Table, outer: pa.Table) -> pa.Table:
    """Proof digests and folded roots of a block's rows."""
    rest = [s for s in outer["path"][0].as_py() if s]
    rows = _siblings(size, block)
    fold = lambda side: f"sha256(CASE substr({side}, 1, 1) WHEN 'l' THEN substr({side}, 2) || folded WHEN 'r' THEN folded || substr({side}, 2) ELSE folded END)"
    folded = rows.append_column("folded", rows["start"])
    for i in range(1, (len(rows["path"][0]) if rows.num_rows else 0) + 1):
        folded = _query(f"SELECT * REPLACE ({fold(f'path[{i}]')} AS folded) FROM rows_", rows_=folded)
    for side in outer["path"][0].as_py():
        folded = _query(f"SELECT * REPLACE ({fold(chr(39) + side + chr(39))} AS folded) FROM rows_", rows_=folded)
    tail = "".join(s[1:] for s in rest)
    return _strings(_query(f"SELECT doc_id, tree, digest AS leaf, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '') || '{tail}') AS proof_sha256, folded AS folded_root FROM rows_", rows_=folded))


_PROOFS = "doc_id long, tree string, leaf string, proof_sha256 string, folded_root string"


def manifest(docs: DataFrame, tampered: Column, size: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's place in the tree of its language and of all.

    ``tampered`` marks rows whose ``n_chars`` is counted up before they are verified against the manifest. Blocks have ``2 ** size`` nodes.
    """
    ship(docs.sparkSession)
    nodes = materialise(placed(leaves(docs, tampered), "doc_id", "digest"), "nodes")
    tiers = _tiers(size, nodes)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    trees = materialise(placed(subroots, "name"), "trees")
    upper = _tiers(size, trees.select("tree", "place", "nodes", "digest"))
    root = upper[-1].select(F.col("digest").alias("root"))
    top = docs.sparkSession.createDataFrame([("", [])], "tree string, path array<string>")
    if len(upper) > 1:
        above = _met(size, trees.select("tree", "place", "nodes", "digest"), _paths(size, upper, top), _outer_path, "tree string, block long, path array<string>")
        above = trees.join(above.select(F.col("block").alias("place"), "path"), "place").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    else:
        above = trees.select(F.col("name").alias("tree"), F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"))
    above = materialise(above.crossJoin(root), "subroots")  # root: one row
    outer = _paths(size, tiers, above) if len(tiers) > 1 else above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    proven = _met(size, nodes, outer, _proof, _PROOFS)
    met = proven.join(above.select("tree", "subroot", "root"), "tree")
    return met.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
