"""A Merkle manifest of a dataset: root, proof and verification for every row.

Rows are leaves. Leaves of one tree (say, one language) are ordered by their id;
every two consecutive nodes become one of the next level, a last odd one is hashed
alone, until one is left, the subroot. Subroots, ordered by the name of their tree,
make the root in the same way. ``H`` is the hex SHA-256 of its inputs' text.

A tree is cut into aligned blocks of ``2 ** HEIGHT`` leaves. A task builds the nodes
of a block, whose root is a leaf of the next round of blocks; so a tree of any size
takes a few rounds, none of which holds more than a block in one group. Then paths
(the siblings on the way to the root) go down again, from block to block.

Trees are persistent: a changed leaf makes a new version by copying its ancestors
only, first those in its block, then those above along the block's path; all other
nodes are shared with the first version. Versions stay in the rows of their leaf's
block, so the number of changes does not matter to the blocks above.

Positions come from a range partitioning by (tree, id, leaf, row), so that neither a
large tree nor an id with many rows lands in one task.

- Null values are hashed as ``-``, others as byte count, ``:`` and text. A null tree is
  a tree of its own and the first one; null ids are the first of their tree.
- Rows of one id are ordered by their leaf; equal rows are leaves of their own.
- A single leaf is its subroot, a single subroot the root; an empty table has no rows.
- A change that leaves a row as it was (a null stays null) is verified.
- Long texts are hashed once and never shuffled. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import column, written

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """Hash of a row's values: each ``-`` if null, else byte count, ``:`` and text."""
    text = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*fields), 256)


def tampered(id_col: str = "doc_id") -> Column:
    """Rows that the check of the manifest changes: 7 divides the CRC of the id's digits."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 7 == 0, F.lit(False))


# Nodes of a block, and versions that share them


def levels_of(leaves: Sequence[str], height: int) -> list[list[str]]:
    """All levels of a block, from its leaves to its root."""
    levels = [list(leaves)]
    for _ in range(height):
        below = levels[-1]
        levels.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings_of(levels: list[list[str]], place: int) -> list[str]:
    """The sibling on every level below the root: ``<`` or ``>`` for its side and
    its digest, or an empty text for a node that is hashed alone."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append(("<" if other < place else ">") + level[other] if other < len(level) else "")
        place >>= 1
    return path


def copied(node: str, path: Sequence[str]) -> list[str]:
    """The ancestors that a version with this node owns, one for each level of the
    path. The path's own digests are those nodes of the first version it shares."""
    owned = []
    for sibling in path:
        if not sibling:
            node = H(node)
        elif sibling[0] == "<":
            node = H(sibling[1:], node)
        else:
            node = H(node, sibling[1:])
        owned.append(node)
    return owned


def block_height(total: int, height: int) -> int:
    """Levels in a block of a tree with so many leaves: fewer if one block holds them."""
    return height if total > 1 << height else max(total - 1, 0).bit_length()


# Positions and blocks


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order``) in their ``tree`` and its ``total``."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")

    def count(batches):
        part, tree, index = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            numbers = []
            for name in batch.column("tree").to_pylist():
                index = index + 1 if name == tree else 0
                tree = name
                numbers.append(index)
            arrays = [pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32())]
            names = [*batch.schema.names, "_index", "_part"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    schema = T.StructType([*ranged.schema.fields]).add("_index", "long").add("_part", "integer")
    placed = written(ranged.mapInArrow(count, schema), "merkle-order")
    counts = placed.groupBy("tree", "_part").agg((F.max("_index") + 1).alias("_count"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(
        F.col("tree").alias("_tree"),
        F.col("_part").alias("_in"),
        (F.sum("_count").over(before) - F.col("_count")).alias("_start"),
        F.sum("_count").over(tree).alias("total"),
    )
    same = (F.col("_part") == F.col("_in")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return (
        placed.join(starts, same)
        .withColumn("place", F.col("_start") + F.col("_index"))
        .drop("_index", "_part", "_tree", "_in", "_start")
    )


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """A row per aligned block: its ``nodes`` (place, node and what else they have)
    in order, and its ``root``. Written, as the paths go through it again."""
    entry = F.struct("place", "node", *[c for c in nodes.columns if c not in ("tree", "total", "place", "node")])
    blocks = nodes.groupBy("tree", F.shiftright("place", height).alias("block"), "total").agg(
        F.array_sort(F.collect_list(entry)).alias("nodes")
    )

    @F.pandas_udf("string")
    def root(leaves: pd.Series, totals: pd.Series) -> pd.Series:
        found = [levels_of(x, block_height(n, height))[-1][0] for x, n in zip(leaves, totals)]
        return pd.Series(found, dtype=object)

    return written(blocks.withColumn("root", root(F.col("nodes.node"), F.col("total"))), "merkle-blocks")


def rounds_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Blocks of leaves, blocks of their roots and so on, until a block is a tree."""
    rounds = [blocks_of(nodes, height)]
    largest = rounds[0].agg(F.max("total")).first()[0] or 0
    while largest > 1 << height:
        rounds.append(
            blocks_of(
                rounds[-1]
                .filter(F.col("total") > 1 << height)
                .select(
                    "tree",
                    F.col("block").alias("place"),
                    F.col("root").alias("node"),
                    F.shiftright(F.col("total") + (1 << height) - 1, height).alias("total"),
                ),
                height,
            )
        )
        largest = -(-largest >> height)
    return rounds


def roots_of(rounds: list[DataFrame], height: int) -> DataFrame:
    """The root of every tree: that of the block which is the whole tree."""
    tops = [r.filter(F.col("total") <= 1 << height).select("tree", "root") for r in rounds]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def with_paths(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Blocks of leaves with ``above``, the path from their root to that of all trees.

    ``above`` has for each tree the path from its root, with what else is to come down
    to its blocks.
    """
    carried = [c for c in above.columns if c not in ("tree", "above")]
    tops = above.withColumn("block", F.lit(0).cast("long"))

    def joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
        paths = paths.withColumnsRenamed({"tree": "_tree", "block": "_block"})
        same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
        return blocks.join(paths, same).drop("_tree", "_block")

    @F.pandas_udf("array<array<string>>")
    def inner(leaves: pd.Series, totals: pd.Series) -> pd.Series:
        found = []
        for x, n in zip(leaves, totals):
            levels = levels_of(x, block_height(n, height))
            found.append([siblings_of(levels, i) for i in range(len(x))])
        return pd.Series(found, dtype=object)

    whole, down = F.col("total") <= 1 << height, None
    for number in reversed(range(len(rounds))):
        blocks = rounds[number]
        known = joined(blocks.filter(whole), tops)
        if down is not None:
            known = known.unionByName(joined(blocks.filter(~whole), down))
        if number == 0:
            return known
        path = inner(F.col("nodes.node"), F.col("total"))
        nodes = F.explode(F.arrays_zip(F.col("nodes.place").alias("block"), path.alias("path")))
        down = known.select("tree", "above", *carried, nodes.alias("_node")).select(
            "tree",
            F.concat("_node.path", "above").alias("above"),
            *carried,
            F.col("_node.block").alias("block"),
        )


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    changed: Column | None = None,
    changes: dict[str, Column] | None = None,
    proofs: bool = False,
    height: int = HEIGHT,
) -> DataFrame:
    """Per row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings,
    level by level), ``folded_root`` (the root of the version with this row's present
    leaf) and ``verified`` (it is the manifest's root).

    ``changes`` has new values of fields for rows where ``changed`` holds; all else is
    of the table as it is in ``docs``. With ``proofs`` there are also ``proof``, the
    siblings with their side, and ``version``, the nodes a changed leaf's version owns.
    """
    if changed is None:
        changed = F.lit(False)
    new = [(changes or {}).get(f, column(f)) for f in fields]
    leaves = docs.select(
        column(tree_col).cast("string").alias("tree"),
        column(id_col).alias("id"),
        leaf([column(f) for f in fields]).alias("node"),
        F.when(changed, leaf(new)).alias("changed"),
    )
    rounds = rounds_of(numbered(written(leaves, "merkle-leaves"), ["id", "node"]), height)
    subroots = roots_of(rounds, height).select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")
    )
    upper = rounds_of(numbered(subroots, ["name"]), height)
    roots = roots_of(upper, height).withColumnRenamed("root", "top")
    tops = roots.select("tree", "top", F.array().cast("array<string>").alias("above"))
    trees = with_paths(upper, tops, height).mapInPandas(
        _tree_paths(height), "tree string, subroot string, top string, above array<string>"
    )
    blocks = with_paths(rounds, written(trees, "merkle-trees"), height)
    id_type = docs.select(column(id_col)).schema[0].dataType
    schema = T.StructType().add("id", id_type)
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")
    schema = schema.add("verified", "boolean")
    if proofs:
        schema = schema.add("proof", T.ArrayType(T.StringType())).add("version", T.ArrayType(T.StringType()))
    arrow = blocks.select("nodes", "total", "above", "subroot", "top")
    return arrow.mapInArrow(_proved(height, proofs), schema).withColumnRenamed("id", id_col)


def _tree_paths(height: int) -> Callable:
    def paths(frames):
        for frame in frames:
            rows = []
            for block in frame.itertuples():
                levels = levels_of([n["node"] for n in block.nodes], block_height(block.total, height))
                for i, n in enumerate(block.nodes):
                    above = [*siblings_of(levels, i), *block.above]
                    rows.append((n["name"], n["node"], block.top, above))
            yield pd.DataFrame(rows, columns=["tree", "subroot", "top", "above"])

    return paths


def _proved(height: int, proofs: bool) -> Callable:
    def prove(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                block = {k: batch.column(k)[b].as_py() for k in ("total", "above", "subroot", "top")}
                nodes = batch.column("nodes").slice(b, 1).flatten()
                ids = nodes.field("id")
                leaves = nodes.field("node").to_pylist()
                levels = levels_of(leaves, block_height(block["total"], height))
                sums, folded, paths, versions = [], [], [], []
                for i, present in enumerate(nodes.field("changed").to_pylist()):
                    path = siblings_of(levels, i) + block["above"]
                    owned = copied(present or leaves[i], path)
                    sums.append(H(*[s[1:] for s in path]))
                    folded.append(owned[-1] if owned else present or leaves[i])
                    if proofs:
                        paths.append(path)
                        versions.append([present, *owned] if present else None)
                n = len(leaves)
                arrays = [
                    ids,
                    pa.array(leaves, pa.string()),
                    pa.array([block["subroot"]] * n, pa.string()),
                    pa.array([block["top"]] * n, pa.string()),
                    pa.array(sums, pa.string()),
                    pa.array(folded, pa.string()),
                    pa.array([f == block["top"] for f in folded], pa.bool_()),
                ]
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if proofs:
                    arrays += [pa.array(x, pa.list_(pa.string())) for x in (paths, versions)]
                    names += ["proof", "version"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return prove
