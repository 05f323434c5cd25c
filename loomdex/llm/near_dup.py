"""Near duplicates by a chosen-path set similarity join.

A document is the set of its shingles (runs of ``SHINGLE`` words). Documents are linked when the Jaccard similarity
of their whole sets reaches ``percent`` of 100; duplicates are the connected components of these links.

1. Signatures: ``COORDINATES`` minwise values of every set. Documents with equal sets are one representative from here on.
2. Paths: in every one of ``TREES`` independent trees a document goes to the node of its minwise token under the tree's
   coordinate. Nodes of more than ``NODE_ROWS`` documents branch: the node chooses ``BRANCHES`` coordinates, its documents go on by
   their tokens there. A node that kept ``DENSE`` of its parent's documents is left whole, as its documents are alike and
   branching would go on for ever.
3. Small nodes are compared exhaustively, by signatures: documents whose estimate reaches ``LEAST_EQUAL`` equal values are
   candidates. A node gives a spanning star of its candidates, never all pairs.
4. Candidates that hang together are brought together with their whole sets. Pairs are confirmed exactly; a pair within a
   component already confirmed tells nothing new and is skipped.
5. Confirmed links are contracted to components.

Nodes and groups of more than ``2 * BLOCK`` documents are compared with some ``PIVOTS`` of their own, chosen by a hash, first: what a
pivot connects is one class, and pairs within a class tell nothing new. Up to ``ROUNDS`` times the documents outside the largest class
choose pivots again; those still outside it are then compared with all, block by block. So a node of near copies costs a number of
comparisons in proportion to its size, and no pair of different classes is left out.

Recall: documents of similarity 0.8 share a token under one coordinate with probability 0.8 and stay together through a branching
with 0.96, so that all 8 trees part them with probability below 1e-4 (0.2**8 = 3e-6 where nodes need no branching); the estimate loses
them with 1e-5. Nothing else is lost, and nothing that is not confirmed is linked.

Cases: a document with fewer words than a shingle has its whole word sequence as its one shingle; one without words, or null,
has an empty set and is linked with nothing; rows that repeat an id count each and get the component of their
own text; ties cannot arise, components take their smallest id (null ids come last); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import batch_rows, fresh_name, materialize, parts

COORDINATES = 128
TREES = 8
BRANCHES = 2
NODE_ROWS = 256
DENSE = 0.5
DEPTH = 8
#: Equal coordinates that make a candidate: 4 deviations below what a similarity of 0.8 has.
LEAST_EQUAL = 83
#: Documents of a block of a node or group that is too large for one comparison.
BLOCK = 1024
#: Pivots of a large node or group (about; a hash chooses them row by row), and rounds of them.
PIVOTS = 16
ROUNDS = 3
#: Bytes of texts whose words are hashed together.
PART_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000

_MULTIPLIERS = np.random.default_rng(20_240_601).integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

SIGNATURE = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]
)


# Sets and signatures


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C3
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of every text."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([w != "" for w in words], bool)[index] if len(words) else np.empty(0, bool)
    hashes = table[index][full] if len(words) else np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    shingles = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        shingles = _mix(shingles * _C1 + hashes[i : i + len(shingles)] * _C2)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from longer ones
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = _mix(whole * _C1 + h.reshape(1) * _C2)
            out.append(_mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minwise values of a set that is not empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[at : at + 1024, None] * _MULTIPLIERS[None, :]).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``doc_id, text_key, n, digest, sig`` of every row; ``text_key`` tells equal texts, ``digest`` equal sets."""

    @F.arrow_udf(SIGNATURE)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, digest, sig = [], [], []
            for part in parts(batch, PART_BYTES):
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["n", "digest", "sig"]
            )

    named = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text).alias("text_key"), of(F.col(text)).alias("s"))
    return named.select("doc_id", "text_key", "s.*")


# Paths


def _rows(column: pa.Array) -> np.ndarray:
    """Signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _node(parent: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    key = parent.astype(np.uint64) * _C1 + coordinate.astype(np.uint64)
    return _mix(_mix(key) * _C2 + token.astype(np.uint64)).astype(np.int64)


ENTRY = "node long, rid long, parent_rows long"


def _entries(node: list, rid: list, parent: list) -> pa.RecordBatch:
    columns = [np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in (node, rid, parent)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["node", "rid", "parent_rows"])


def first_nodes(reps: DataFrame) -> DataFrame:
    """Every tree's first node of every representative."""
    chosen = [t * (COORDINATES // TREES) for t in range(TREES)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = batch.column(0).to_numpy(), _rows(batch.column(1))
            nodes = [_node(np.full(len(rid), t), np.full(len(rid), c), sig[:, c]) for t, c in enumerate(chosen)]
            yield _entries(nodes, [rid] * TREES, [np.zeros(len(rid))] * TREES)

    return reps.select("rid", "sig").mapInArrow(place, ENTRY)


def branch(entries: DataFrame) -> DataFrame:
    """Children of nodes: ``node, rid, rows, sig`` to ``node, rid, parent_rows``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, rid, rows = (batch.column(i).to_numpy() for i in range(3))
            sig = _rows(batch.column(3))
            nodes = []
            first = _mix(_mix(node.astype(np.uint64) * _C1))
            for k in range(BRANCHES):  # coordinates of a node are its own, whoever its documents are
                c = ((first + np.uint64(k * (COORDINATES // BRANCHES))) % np.uint64(COORDINATES)).astype(np.int64)
                nodes.append(_node(node, c, sig[np.arange(len(sig)), c]))
            yield _entries(nodes, [rid] * BRANCHES, [rows] * BRANCHES)

    return entries.select("node", "rid", "rows", "sig").mapInArrow(place, ENTRY)


def leaves(reps: DataFrame) -> tuple[DataFrame, bool]:
    """``node, rid, rows`` of all nodes that are compared, and whether some are large."""
    entries, found, large = materialize(first_nodes(reps), "paths-1"), None, False
    for depth in range(1, DEPTH + 1):
        sizes = entries.groupBy("node").agg(F.count("*").alias("rows"), F.first("parent_rows").alias("_parent")).where("rows > 1")
        compared = (F.col("rows") <= NODE_ROWS) | (F.col("rows") >= DENSE * F.col("_parent")) & (F.col("_parent") > 0)
        if depth == DEPTH:
            compared = F.lit(True)
        sizes = materialize(sizes.select("node", "rows", compared.alias("compared")), "nodes")
        leaf = entries.join(sizes.where("compared").drop("compared"), "node").select("node", "rid", "rows")
        found = leaf if found is None else found.unionByName(leaf)
        large = large or not sizes.where("compared").where(F.col("rows") > 2 * BLOCK).isEmpty()
        wide = sizes.where("NOT compared").drop("compared")
        if wide.isEmpty():
            break
        wide = entries.join(wide, "node").select("node", "rid", "rows").join(reps.select("rid", "sig"), "rid")
        entries = materialize(branch(wide), f"paths-{depth + 1}")
    return found, large


# Comparison


def _short(sig: np.ndarray) -> np.ndarray:
    """A byte of each minwise value: equal values stay equal, others agree by chance once in 256 times."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


@F.arrow_udf(T.BinaryType())
def short_signature(sig: pa.Array) -> pa.Array:
    data = _short(_rows(sig))
    return pa.array([row.tobytes() for row in data], pa.binary())


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest row connected with each row) after the rows of ``a`` and ``b`` are connected in pairs."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


RAY = "place long, a long, b long, pivot boolean"


def connect(table: pa.Table, n: np.ndarray, confirmed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """``RAY`` rows: in every cell (rows are sorted by cell and side) a star for each class of labels that pairs have connected.

    ``a``: the label of the class's first row, a pivot's if the cell has pivots; ``b``: its other labels; ``pivot``: ``b`` is one's, too. Pairs of a cell (across its two sides, or all on side 0) are compared by size and signature, and then by ``confirmed(a, b)``,
    unless their label or what came before has connected them already. Memory goes with the rows, not with the pairs.
    """
    cell, side, label, place = (table.column(c).to_numpy() for c in ("cell", "side", "label", "place"))
    sig = np.frombuffer(b"".join(table.column("sig8").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    order = np.lexsort((label, cell))
    new = np.ones(len(cell), bool)
    new[1:] = (cell[order][1:] != cell[order][:-1]) | (label[order][1:] != label[order][:-1])
    heads, root = order[new], np.empty(len(cell), np.int64)
    root[order] = heads[np.cumsum(new) - 1]
    for k in range(1, len(cell)):
        same = cell[:-k] == cell[k:]
        if not same.any():
            break
        a = np.nonzero(same & ((side[:-k] == 0) | (side[:-k] != side[k:])))[0]
        b = a + k
        apart = root[a] != root[b]
        apart &= 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
        a, b = a[apart], b[apart]
        for at in range(0, len(a), 16_384):
            x, y = a[at : at + 16_384], b[at : at + 16_384]
            near = (sig[x] == sig[y]).sum(axis=1) >= LEAST_EQUAL
            x, y = x[near], y[near]
            if not len(x):
                continue
            sure = confirmed(x, y)
            root = merge(root, x[sure], y[sure])
    spoke = heads[root[heads] != heads]
    columns = [place[spoke], label[root[spoke]], label[spoke], side[spoke] == 1]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["place", "a", "b", "pivot"])


def whole_cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of whole cells, of about ``size`` bytes; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        cell = table.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _united(pairs: Column) -> Column:
    """``array<struct<label,to>>``: labels of a large group's pivots with the smallest ones they are connected with by ``near, end`` pairs."""
    labels = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["near"]), F.transform(pairs, lambda p: p["end"])))
    alone = F.transform(labels, lambda x: F.struct(x.alias("label"), x.alias("to")))

    def unite(rows: Column, pair: Column) -> Column:
        met = F.filter(rows, lambda x: (x["label"] == pair["near"]) | (x["label"] == pair["end"]))
        met = F.transform(met, lambda x: x["to"])
        to = lambda x: F.when(F.array_contains(met, x["to"]), F.array_min(met)).otherwise(x["to"])
        return F.transform(rows, lambda x: F.struct(x["label"].alias("label"), to(x).alias("to")))

    return F.aggregate(pairs, alone, unite)


def relabelled(rest: DataFrame, rays: DataFrame) -> DataFrame:
    """``rest`` (``place, label`` and more) with the labels after its groups' ``rays``.

    Rays start at labels of pivots. So only these have to be united, some ``PIVOTS`` of a group, and every other label takes that of a
    pivot that reaches it.
    """
    reached = rays.groupBy("place", "b", "pivot").agg(F.min("a").alias("near"), F.collect_set("a").alias("ends"))
    ends = F.explode(F.when(F.col("pivot"), F.array_append("ends", F.col("b"))).otherwise(F.col("ends")))
    pairs = reached.select("place", "near", ends.alias("end")).distinct()  # of labels of pivots
    united = pairs.groupBy("place").agg(_united(F.collect_list(F.struct("near", "end"))).alias("u")).select("place", F.inline("u"))
    others = reached.where("NOT pivot").join(united.withColumnRenamed("label", "near"), ["place", "near"])
    moved = united.unionByName(others.select("place", F.col("b").alias("label"), "to"))
    return rest.join(moved, ["place", "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def spanning(members: DataFrame, group: str, large: bool, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: edges that connect, within every group, what ``compare`` finds alike.

    ``members``: ``rid, group, rows`` and what ``compare`` reads beside ``place, cell, side, label``. ``large``: some groups have more than
    ``2 * BLOCK`` rows. A large group's rows lie in blocks, one cell each, to which copies of the pivots are sent.
    """
    members = members.withColumnRenamed(group, "place").withColumn("label", F.col("rid"))
    small = members.where(F.col("rows") <= 2 * BLOCK)
    found = compare(small.withColumns({"cell": F.xxhash64("place"), "side": F.lit(0)})).select("a", "b")
    if not large:
        return found
    wide = members.where(F.col("rows") > 2 * BLOCK)
    rest = materialize(wide.withColumns({"outside": F.lit(True), "_others": F.col("rows")}), "wide")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid", F.lit("block")), blocks).cast("int")
    for k in range(ROUNDS):
        pivot = F.col("outside") & (F.pmod(F.xxhash64("rid", F.lit(f"pivot {k}")), F.col("_others")) < PIVOTS)
        pivots = rest.where(pivot).withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(1))
        cells = pivots.unionByName(rest.withColumns({"_block": own, "side": F.lit(2)}))
        rays = materialize(compare(cells.withColumn("cell", F.xxhash64("place", "_block", F.lit(k)))), "rays")
        found = found.unionByName(rays.select("a", "b"))
        labelled = materialize(relabelled(rest.drop("outside", "_others"), rays), "labelled")
        classes = labelled.groupBy("place", "label").agg(F.count("*").alias("_alike")).groupBy("place")
        classes = classes.agg(
            F.max_by("label", F.struct("_alike", "label")).alias("_main"), (F.sum("_alike") - F.max("_alike")).alias("_others")
        )
        classes = materialize(classes.where("_others > 0"), "classes")
        if classes.isEmpty():
            return found
        rest = labelled.join(classes, "place").withColumn("outside", F.col("label") != F.col("_main")).drop("_main")
    # the exact way for what is left: rows outside the largest class against all rows of the group, in pairs of blocks
    shares = F.ceil(F.col("_others") / BLOCK).cast("int")
    outside = rest.where("outside").withColumn("_share", F.pmod(F.xxhash64("rid", F.lit("share")), shares).cast("int"))
    outside = outside.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(1))
    every = rest.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumns({"_block": own, "side": F.lit(2)})
    cells = outside.unionByName(every).withColumn("cell", F.xxhash64("place", "_share", "_block", F.lit("rest")))
    return found.unionByName(compare(cells).select("a", "b"))


def candidates(leaf: DataFrame, large: bool, reps: DataFrame) -> DataFrame:
    """``a, b``: stars that span the candidates of every node."""
    short = reps.select("rid", "n", short_signature("sig").alias("sig8"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 8 << 20):
            yield connect(table, table.column("n").to_numpy(), lambda a, b: np.ones(len(a), bool))

    def compare(cells: DataFrame) -> DataFrame:
        chosen = cells.select("place", "cell", "side", "label", "n", "sig8").repartition("cell").sortWithinPartitions("cell", "side")
        return chosen.mapInArrow(stars, RAY)

    return spanning(leaf.join(short, "rid"), "node", large, compare).distinct()


def confirm(sets: DataFrame, large: bool, percent: int) -> DataFrame:
    """``a, b``: links confirmed on the whole sets that span each group's components.

    ``sets``: ``group, rows, rid, sig8, hashes`` (sorted 64-bit numbers).
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 16 << 20):
            hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
            n = np.array([len(h) for h in hashes])

            def confirmed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                both = [len(np.intersect1d(hashes[x], hashes[y], assume_unique=True)) for x, y in zip(a, b)]  # noqa: B023
                both = np.array(both, np.int64)
                return 100 * both >= percent * (n[a] + n[b] - both)  # noqa: B023

            yield connect(table, n, confirmed)

    def compare(cells: DataFrame) -> DataFrame:
        chosen = cells.select("place", "cell", "side", "label", "sig8", "hashes").repartition("cell").sortWithinPartitions("cell", "side")
        return chosen.mapInArrow(links, RAY)

    return spanning(sets, "group", large, compare)


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of every end of an edge; equal labels are connected, labels are the smallest ids.

    Each round every label joins its smallest neighbour, two steps at once; edges within a label go. Labels are at least
    halved per round. Neighbours are aggregated before they are shuffled.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("label"), F.least("a", "b").alias("to"))
        step = near.select(F.col("label").alias("to"), F.col("to").alias("_next"))
        near = materialize(near.join(step, "to", "left").select("label", F.coalesce("_next", "to").alias("to")), "nearest")
        labels = materialize(
            labels.join(near, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels"
        )
        ends = {c: near.select(F.col("label").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"}
        moved = edges.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, doc_id: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept, component`` of every row.

    ``text_key`` is null for a null text; ``component`` numbers the components of this run, also those without any id.
    """
    if percent < 80:
        raise ValueError("trees and estimate are laid out for similarities from 80 percent on")
    with batch_rows(docs.sparkSession, BATCH_ROWS):  # all Python work ends in written tables before this returns
        return _near_duplicates(docs, doc_id, text, size, percent)


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    signed = materialize(signatures(docs, doc_id, text, size), "signatures")
    named = signed.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    reps = materialize(named.withColumn("rid", F.monotonically_increasing_id()), "representatives")
    stars = candidates(*leaves(reps), reps)
    groups = components(stars).withColumnsRenamed({"id": "rid", "label": "group"})
    sizes = groups.groupBy("group").agg(F.count("*").alias("rows"))
    members = groups.join(sizes, "group").join(reps, "rid").select("rid", "group", "rows", "doc_id", "text_key", "digest", short_signature("sig").alias("sig8"))
    members = materialize(members, "members")
    large = not members.where(F.col("rows") > 2 * BLOCK).isEmpty()

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "group", "rows", "sig8"]
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in (*names, "digest", "text")}
            at = 0
            for part in parts(column["text"], PART_BYTES):
                hashes = [s.tobytes() for s in shingle_sets(part, size)]
                rows = slice(at, at + len(part))
                digests = column["digest"][rows].to_pylist()
                own = [hashlib.blake2b(h, digest_size=16).digest() == d for h, d in zip(hashes, digests)]
                out = pa.RecordBatch.from_arrays([*(column[c][rows] for c in names), pa.array(hashes, pa.binary())], [*names, "hashes"])
                yield out.filter(pa.array(own, pa.bool_()))
                at += len(part)

    # sets are made after the join: texts move, sets of documents without candidates are never made
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the small side is hashed, so that texts are not sorted
    columns = ["rid", "group", "rows", "sig8", "digest", "text"]
    named = members.where("doc_id IS NOT NULL").hint("shuffle_hash").join(texts.where("doc_id IS NOT NULL"), "doc_id").select(columns)
    # sets that only rows without an id have: their texts are told by their digests, one row of each
    nameless = texts.where("doc_id IS NULL").groupBy(F.md5("text").alias("text_key")).agg(F.first("text").alias("text"))
    nameless = members.where("doc_id IS NULL").join(nameless, "text_key").select(columns)
    made = "rid long, group long, rows long, sig8 binary, hashes binary"
    wanted = named.mapInArrow(with_sets, made).unionByName(nameless.mapInArrow(with_sets, made)).dropDuplicates(["rid"])
    wanted = materialize(wanted, "sets") if large else wanted  # read more than once then
    linked = components(confirm(wanted, large, percent)).withColumnRenamed("id", "rid")
    of_rep = reps.select("rid", "digest", F.col("doc_id").alias("_first")).join(linked, "rid", "left")
    of_rep = of_rep.withColumn("label", F.coalesce("label", "rid"))
    smallest = of_rep.groupBy("label").agg(F.min("_first").alias("component_id"))
    of_rep = of_rep.join(smallest, "label").select("digest", "component_id", F.col("label").alias("component"))
    of_rep = materialize(of_rep, "components")
    # documents without words are their own components
    full = signed.where("n > 0").select("doc_id", "text_key", "digest", "n").join(of_rep, "digest").drop("digest")
    alone = F.lit(None).cast("long").alias("component")
    none = signed.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), alone)
    return full.unionByName(none).select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "component",
    )


def drop_duplicates(docs: DataFrame, doc_id: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component: that with the smallest id; rows without words all stay.

    Of rows that repeat both id and text one stays. In a component whose ids are all null one row of one text stays.
    """
    found = materialize(near_duplicates(docs, doc_id, text, size, percent), "near-duplicates")
    nameless = (F.col("doc_id").isNull()) & (F.col("n_shingles") > 0)
    chosen = found.where("kept").where(nameless).groupBy("component").agg(F.min("text_key").alias("_text"))
    chosen = chosen.select(F.lit(None).cast(found.schema["doc_id"].dataType).alias("_id"), "_text", F.lit(True).alias("_once"))
    stay = found.where("kept").where(~nameless).groupBy("doc_id", "text_key").agg((F.min("n_shingles") > 0).alias("_full"), F.count("*").alias("_rows"))
    key = fresh_name(docs, "_key")
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), (F.col("_full") & (F.col("_rows") > 1)).alias("_once"))
    stay = materialize(stay.unionByName(chosen), "stay")
    keyed = docs.withColumn(key, F.md5(text))
    same = [keyed[doc_id].eqNullSafe(stay["_id"]), keyed[key].eqNullSafe(stay["_text"])]
    kept = keyed.join(stay.where("NOT _once"), same, "left_semi")
    if stay.where("_once").isEmpty():  # no row repeats both id and text
        return kept.drop(key)
    repeated = keyed.join(stay.where("_once"), same, "left_semi").dropDuplicates([doc_id, key])
    return kept.unionByName(repeated).drop(key)
