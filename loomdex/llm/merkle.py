"""Merkle manifest of a dataset: a tree per group, a tree over the groups, and a proof for every row.

A leaf is the digest of a row's fields. Within a group leaves ascend by the order column, and runs of two nodes become
their parent until one node, the group's subroot, remains; subroots in the order of their groups make the root in the
same way. A node without a partner becomes a parent of its own.

Trees are cut into aligned subtrees of ``2 ** HEIGHT`` leaves. A subtree is one table row whose digests lie in van Emde Boas
order: the tree is split at half its height, the top part is stored first, then every bottom part, each by the same
rule. Where a node lies follows from three numbers per depth (:class:`Layout`), so building a subtree and reading the
siblings of a leaf are arithmetic on addresses, and walks towards the root touch few memory blocks whatever their
size. The roots of the subtrees are the leaves of the next level, until a group has a single one; proofs go down again by
one join per level.

No group meets in one task: ranks come from a range partitioning by group and order with one offset per pair of partition
and group, and a group's rows are spread over its subtrees.

Cases: a null field, also the group or the order column, is ``-`` in its leaf; null groups and null order values come first; rows
that repeat an order value are ordered by their leaves, and rows that repeat everything keep a proof each; an empty table
gives no rows; a group of one row has the leaf as its subroot; texts of any length are hashed whole; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.llm.common import materialize

#: Levels of parents in a subtree; it has up to ``2 ** HEIGHT`` leaves.
HEIGHT = 11
DIGEST = 32
#: A step of a proof: its first byte tells whether the sibling stands left or right, or that there is none.
NONE, LEFT, RIGHT = 0, 1, 2
STEP = DIGEST + 1


# Van Emde Boas order


class Layout:
    """Addresses of the nodes of a perfect tree of ``height`` levels of edges.

    For every depth: the depth of the root of the top part above it, the number of nodes of that top part, and the number
    of nodes of each bottom part that begins at this depth.
    """

    def __init__(self, height: int):
        self.height = height
        self.top_depth, self.top_nodes, self.bottom_nodes = ([0] * (height + 1) for _ in range(3))
        self._split(0, height + 1)

    def _split(self, depth: int, levels: int) -> None:
        """Tree of ``levels`` levels whose root lies at ``depth``: the upper half, then the lower halves."""
        if levels == 1:
            return
        top = levels // 2
        below = depth + top
        self.top_depth[below] = depth
        self.top_nodes[below] = (1 << top) - 1
        self.bottom_nodes[below] = (1 << (levels - top)) - 1
        self._split(depth, top)
        self._split(below, levels - top)

    def addresses(self, depth: int, index: np.ndarray) -> np.ndarray:
        """Where the nodes ``index`` (from the left) of a depth lie.

        The address of a bottom part's root is that of the tree's root, plus the top part, plus the bottom parts left of it.
        """
        index = np.asarray(index, np.int64)
        if depth == 0:
            return np.zeros_like(index)
        up = self.top_depth[depth]
        root = index >> (depth - up)
        own = index & self.top_nodes[depth]
        return self.addresses(up, root) + self.top_nodes[depth] + own * self.bottom_nodes[depth]


@lru_cache(maxsize=8)
def _layout(height: int) -> tuple[Layout, list[np.ndarray]]:
    """The layout and, by depth, the addresses of all nodes of a subtree."""
    layout = Layout(height)
    return layout, [layout.addresses(d, np.arange(1 << d)) for d in range(height + 1)]


def _parent(left: bytes, right: bytes | None) -> bytes:
    return sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


def build_subtree(leaves: Sequence[bytes], levels: int, height: int) -> tuple[bytes, bytes]:
    """Digests of a subtree in van Emde Boas order, and its root after ``levels`` levels; absent nodes are zeros."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    _, where = _layout(height)
    row = list(leaves)
    nodes[where[height][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
    for up in range(1, levels + 1):
        row = [_parent(row[i], row[i + 1] if i + 1 < len(row) else None) for i in range(0, len(row), 2)]
        nodes[where[height - up][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes(), row[0]


def steps_of(subtree: bytes, rows: int, levels: int, height: int) -> list[bytes]:
    """The steps from each of the first ``rows`` leaves to the subtree's root."""
    nodes = np.frombuffer(subtree, np.uint8).reshape(-1, DIGEST)
    layout, _ = _layout(height)
    index, count = np.arange(rows), rows
    out = np.zeros((rows, levels, STEP), np.uint8)
    for up in range(levels):
        sibling = index ^ 1
        there = sibling < count
        at = layout.addresses(height - up, np.where(there, sibling, index))
        out[:, up, 0] = np.where(there, np.where(index & 1, LEFT, RIGHT), NONE)
        out[there, up, 1:] = nodes[at[there]]
        index, count = index >> 1, (count + 1) >> 1
    return [row.tobytes() for row in out]


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its steps lead to."""
    digest = leaf.hex()
    for at in range(0, len(proof), STEP):
        side, sibling = proof[at], proof[at + 1 : at + STEP].hex()
        joined = digest if side == NONE else sibling + digest if side == LEFT else digest + sibling
        digest = sha256(joined.encode()).hexdigest()
    return bytes.fromhex(digest)


def siblings_digest(proof: bytes) -> str:
    """Digest of the siblings of a proof, from the leaf to the root."""
    held = [proof[at + 1 : at + STEP].hex() for at in range(0, len(proof), STEP) if proof[at] != NONE]
    return sha256("".join(held).encode()).hexdigest()


# Leaves and ranks


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0 within its group, by ``order``, nulls first) and ``total`` (rows of the group).

    A stored range partitioning numbers its rows; one offset per partition and group makes ranks of them.
    """
    tie = "_tie"  # last: rows that are equal in all columns still spread over partitions
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)] + [F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.drop(tie).withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_group")
    offsets = counts.select(
        "_group",
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_rows").over(every).alias("total"),
    )
    same = [dealt[group].eqNullSafe(offsets["_group"]), part == offsets["_part"]]
    return dealt.join(offsets, same).withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_group", "_part", "_offset")


# Trees


def _levels(total: int, height: int) -> int:
    """Levels of parents in the subtrees of a group: all of them where it has more than one subtree."""
    return min(height, (total - 1).bit_length())


_SUBTREE = "id long, block long, rows long, total long, nodes binary, root binary"


def _subtrees(nodes: DataFrame, height: int) -> DataFrame:
    """``id, rank, digest, total`` to one row per subtree."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        total, rank = table.column("total")[0].as_py(), table.column("rank")[0].as_py()
        body, root = build_subtree(table.column("digest").to_pylist(), _levels(total, height), height)
        own = [[table.column("id")[0].as_py()], [rank >> height], [table.num_rows], [total], [body], [root]]
        return pa.Table.from_arrays(
            [pa.array(v, t) for v, t in zip(own, (*[pa.int64()] * 4, pa.binary(), pa.binary()))],
            ["id", "block", "rows", "total", "nodes", "root"],
        )

    blocks = nodes.withColumn("block", F.shiftright("rank", height))
    return blocks.groupBy("id", "block").applyInArrow(build, _SUBTREE)


def _proofs(subtrees: DataFrame, height: int) -> DataFrame:
    """``id, rank, subroot, proof`` of every leaf of subtrees that carry ``above`` (their own proof) and ``subroot``."""

    def read(batches):
        for batch in batches:
            ids, ranks, roots, proofs = [], [], [], []
            for row in batch.to_pylist():
                steps = steps_of(row["nodes"], row["rows"], _levels(row["total"], height), height)
                ids += [row["id"]] * len(steps)
                ranks += range(row["block"] << height, (row["block"] << height) + len(steps))
                roots += [row["subroot"]] * len(steps)
                proofs += [s + row["above"] for s in steps]
            columns = [pa.array(ids, pa.int64()), pa.array(ranks, pa.int64()), pa.array(roots, pa.binary()), pa.array(proofs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "rank", "subroot", "proof"])

    # a subtree is a large row, and its proofs are larger still: few at a time
    columns = subtrees.select("id", "block", "rows", "total", "nodes", "above", "subroot")
    return columns.mapInArrow(read, "id long, rank long, subroot binary, proof binary")


def forest(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Subtrees of the trees of all ids, level by level, and ``id, subroot``. ``nodes``: ``id, rank, digest, total``."""
    levels, tops = [], None
    while True:
        own = materialize(_subtrees(nodes, height), f"subtrees-{len(levels)}")
        levels.append(own)
        single = F.col("total") <= 1 << height
        top = own.where(single).select("id", F.col("root").alias("subroot"))
        tops = top if tops is None else tops.unionByName(top)
        wide = own.where(~single)
        if wide.isEmpty():
            return levels, tops
        total = F.shiftright(F.col("total") + (1 << height) - 1, height)
        nodes = wide.select("id", F.col("block").alias("rank"), F.col("root").alias("digest"), total.alias("total"))


def descend(levels: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The subtrees of the lowest level with ``subroot`` and ``above``, their proof. ``above``: ``id, subroot, proof`` of each tree's root."""
    carried = None
    for own in reversed(levels):
        single = F.col("total") <= 1 << height
        tops = own.where(single).join(above.withColumnRenamed("proof", "above"), "id")
        if carried is None:
            joined = tops
        else:
            proofs = _proofs(carried, height).withColumnsRenamed({"rank": "block", "proof": "above"})
            joined = tops.unionByName(own.where(~single).join(proofs, ["id", "block"]), allowMissingColumns=True)
        carried = materialize(joined.select("id", "block", "rows", "total", "nodes", "above", "subroot"), "proven")
    return carried


_OUT = "row_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(
    docs: DataFrame,
    group: str,
    order: str,
    fields: Sequence[str],
    tampered: Callable[[DataFrame], Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: ``row_id`` (the order column), ``leaf, subroot, root, proof_sha256`` and the check of its proof.

    ``tampered`` gives the leaf that is checked against the original siblings, by default the leaf itself.
    """
    own = leaf_digest([F.col(c) for c in fields])
    rows = docs.select(
        F.col(group).alias("_lang"),
        F.col(order).alias("row_id"),
        F.unhex(own).alias("digest"),
        F.unhex(tampered(docs) if tampered else own).alias("checked"),
    )
    leaves = ranked(rows, "_lang", ["row_id", "digest"])
    # groups are numbered by their order, as the rows of one tree
    numbered = ranked(leaves.where("rank = 0").select(F.lit(0).alias("_one"), "_lang"), "_one", ["_lang"])
    numbered = materialize(numbered.select("_lang", F.col("rank").alias("id"), F.col("total").alias("groups")), "groups")
    number = numbered.select(F.col("_lang").alias("_name"), "id")
    # how the rows of a hot group find their number is left to the optimizer: few groups are sent to them, else the join is split
    leaves = leaves.join(number, leaves["_lang"].eqNullSafe(number["_name"])).drop("_lang", "_name")
    leaves = materialize(leaves, "numbered")

    levels, tops = forest(leaves.select("id", "rank", "digest", "total"), height)
    tops = materialize(tops, "subroots")
    over = tops.join(numbered.select("id", "groups"), "id").select(
        F.lit(0).cast("long").alias("id"), F.col("id").alias("rank"), F.col("subroot").alias("digest"), F.col("groups").alias("total")
    )
    upper, root = forest(over, height)
    top = materialize(root, "root").first()
    if top is None:
        kind = docs.schema[order].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], _OUT.format(kind=kind))
    crown = docs.sparkSession.createDataFrame([(0, bytes(top["subroot"]), b"")], "id long, subroot binary, proof binary")
    to_root = _proofs(descend(upper, crown, height), height).select(F.col("rank").alias("id"), "proof")
    lowest = descend(levels, tops.join(to_root, "id"), height)
    return _checked(leaves, lowest, bytes(top["subroot"]), docs.schema[order].dataType.simpleString(), height)


def _checked(leaves: DataFrame, subtrees: DataFrame, root: bytes, kind: str, height: int) -> DataFrame:
    """Every leaf with the digest of its proof and the root it folds to, subtree by subtree."""
    schema = pa.schema(
        [("row_id", to_arrow_type(leaves.schema["row_id"].dataType))]
        + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [("verified", pa.bool_())]
    )

    def check(key: tuple, rows: pa.Table, subtree: pa.Table) -> pa.Table:
        tree = subtree.to_pylist()[0]
        steps = steps_of(tree["nodes"], tree["rows"], _levels(tree["total"], height), height)
        first, above, subroot = tree["block"] << height, tree["above"], tree["subroot"].hex()
        out: list[list] = [[] for _ in schema]
        columns = (rows.column(c).to_pylist() for c in ("row_id", "rank", "digest", "checked"))
        for name, rank, digest, checked in zip(*columns):
            proof = steps[rank - first] + above
            folded = fold(checked, proof)
            row = (name, digest.hex(), subroot, root.hex(), siblings_digest(proof), folded.hex(), folded == root)
            for column, value in zip(out, row):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    keyed = leaves.select("id", F.shiftright("rank", height).alias("block"), "row_id", "rank", "digest", "checked")
    return keyed.groupBy("id", "block").cogroup(subtrees.groupBy("id", "block")).applyInArrow(check, _OUT.format(kind=kind))
