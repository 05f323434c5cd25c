"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents are linked when their texts are equal. Labels are shards. All documents of a group that have one label are
alike, so the state is a count per group and label: a group holds at most as many rows as there are shards, however
many documents it has.

1. Every document begins with a label from its id's hash.
2. Rounds: the documents of a group wish to go to the group's most frequent label; groups with equal labels choose among them
   by a hash. Wishes are granted in part against the room of a shard and what leaves it in the same round, so full shards
   swap; a small group moves whole or not at all. Large groups come last and move in part, to shards with room. Rounds end
   when nobody moves, or after ``ROUNDS``; small groups that are still cut then join their most frequent label.
3. Settling: quotas are exact (counts differ by one at most). A shard keeps linked documents up to its quota, large
   groups first; the rest, whole groups but for the last of a shard, and the documents without links fill the vacant slots.
   Positions come from counts per hashed bucket.

Driver and broadcasts hold numbers per shard and pair of shards only. Cases: a null text has no size and no links; empty texts are linked
like other equal texts; rows that repeat a document id count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm.common import materialize

#: Rounds of propagation at most.
ROUNDS = 12
#: Part of a shard's quota from which a group is large.
LARGE = 0.25
#: Rows of a bucket, about, and buckets at least.
BUCKET_ROWS = 20_000
BUCKETS = 256
#: Documents from which a group keeps its place before smaller ones, since it fits into fewer gaps.
FIRM = 64


def _by_shard(values: list[int]) -> Column:
    """Number of the shard in column ``shard``; one value per shard."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)


def _chance(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / 1_000_003.0


def linked_counts(rows: DataFrame, shards: int) -> DataFrame:
    """``group, shard, n`` of the groups of two or more; partial sums come before the shuffle."""
    first = rows.where("group IS NOT NULL").groupBy("group", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    counts = first.agg(F.count("*").alias("n"))
    total = Window.partitionBy("group")  # at most one row per shard
    return counts.withColumn("_all", F.sum("n").over(total)).where("_all > 1").drop("_all")


def _loads(counts: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _granted(flows: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shares of the wishes, small groups' and large ones', that each shard grants; ``flows[large, of, to]`` are documents.

    The shares go down from one until no shard takes in more than its room and what leaves it.
    """
    asked = flows.sum(axis=1)
    shares = np.ones_like(asked)
    for _ in range(1000):
        space = np.maximum(0.0, room + np.einsum("lat,lt->a", flows, shares))
        left = np.maximum(0.0, space - shares[0] * asked[0])
        lower = np.minimum(shares, np.stack([space, left]) / np.maximum(1.0, asked))
        if np.abs(shares - lower).max() < 1e-6:
            break
        shares = lower
    return shares


def _aims(counts: DataFrame, quota: int, open_shard: Column, loads: list[int], turn: int) -> DataFrame:
    """``group, large, aim, aim_n``: a label of the group's most frequent ones; large groups have one that is open, or none."""
    free = F.struct("n", F.xxhash64("group", "shard", F.lit(turn)).alias("tie"), "shard")
    roomy = F.when(open_shard, F.struct("n", (-_by_shard(loads)).alias("tie"), "shard"))
    best = counts.groupBy("group").agg(F.sum("n").alias("total"), F.max(free).alias("free"), F.max(roomy).alias("roomy"))
    large = F.col("total") > quota * LARGE
    pick = lambda name: F.when(large, F.col("roomy")[name]).otherwise(F.col("free")[name])
    return best.select("group", large.cast("int").alias("large"), pick("shard").alias("aim"), pick("n").alias("aim_n"))


def propagate(counts: DataFrame, quota: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Final ``group, shard, n``."""
    counts = materialize(counts, "labels")
    for turn in range(rounds):
        loads = _loads(counts, shards)
        room = np.array([quota - x for x in loads], float)
        open_shard = _by_shard([max(0, quota - x) for x in loads]) > 0
        wishes = counts.join(_aims(counts, quota, open_shard, loads, turn), "group").select(
            "group",
            "shard",
            "n",
            "large",
            # towards as many neighbours or more; the group has one aim per round, so equals do not swap places
            F.when((F.col("aim_n") >= F.col("n")) & (F.col("aim") != F.col("shard")), F.col("aim")).alias("to"),
        )
        wishes = materialize(wishes, "wishes")
        flows = np.zeros((2, shards, shards))
        for r in wishes.where("to IS NOT NULL").groupBy("large", "shard", "to").agg(F.sum("n").alias("n")).collect():
            flows[r["large"], r["shard"], r["to"]] = r["n"]
        granted = _granted(flows, room)
        if not (granted * flows.sum(axis=1)).any():
            break
        shares = [F.element_at(F.array(*(F.lit(float(x)) for x in g)), F.col("to") + 1) for g in granted]
        # a small group stays whole, a large one cannot
        whole = F.when(_chance("group", F.lit(turn)) < shares[0], F.col("n")).otherwise(0)
        part = F.least(F.floor(F.col("n") * shares[1] + _chance("group", "shard", F.lit(turn))), F.col("n"))
        moved = F.when(F.col("to").isNull(), 0).when(F.col("large") == 0, whole).otherwise(part)
        stay = wishes.select("group", "shard", (F.col("n") - moved).alias("n"))
        go = wishes.where("to IS NOT NULL").select("group", F.col("to").alias("shard"), moved.alias("n"))
        counts = stay.unionByName(go).where("n > 0").groupBy("group", "shard").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "labels")
    aims = _aims(counts, quota, F.lit(False), [0] * shards, rounds)
    united = counts.join(aims, "group").withColumn("shard", F.when(F.col("large") == 0, F.col("aim")).otherwise(F.col("shard")))
    return materialize(united.groupBy("group", "shard").agg(F.sum("n").alias("n")), "labels")


def _labels(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` (null without links) and ``alike``, the size of the group: each takes a label of its group in proportion to the counts."""
    order = F.sort_array(F.collect_list(F.struct("shard", "n")))
    shares = counts.groupBy("group").agg(order.alias("labels"), F.sum("n").alias("total"))
    running = F.transform(
        "labels",
        lambda x, i: F.struct(
            x["shard"].alias("shard"), F.aggregate(F.slice("labels", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")
        ),
    )
    shares = shares.select("group", running.alias("labels"), "total")
    place = _chance("row", F.lit("label")) * F.col("total")
    chosen = F.filter("labels", lambda x: x["upto"] > place)[0]["shard"]
    return rows.join(shares, "group", "left").withColumn("shard", chosen).drop("labels").withColumnRenamed("total", "alike")


def cut_share(placed: DataFrame) -> float:
    """Share of the groups of two or more whose documents lie in several shards, of a table from ``place_documents``."""
    spread = placed.where("linked").groupBy("group", "shard").count().groupBy("group").count()
    return spread.agg(F.coalesce(F.avg((F.col("count") > 1).cast("double")), F.lit(0.0))).first()[0]


def shard_documents(docs: DataFrame, doc_id: str, text: str, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, and ``linked`` (the document has a copy)."""
    return place_documents(docs, doc_id, text, shards).drop("group")


def place_documents(docs: DataFrame, doc_id: str, text: str, shards: int = 24) -> DataFrame:
    """What ``shard_documents`` gives, with the hash of the text in ``group``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.md5(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    counts = propagate(linked_counts(rows, shards), max(1, total // shards), shards)
    labelled = materialize(_labels(rows, counts), "labelled")

    buckets = max(BUCKETS, total // BUCKET_ROWS)
    # small groups lie in one bucket each, so that what a full shard gives up are whole groups; firm ones come first
    whole = F.col("alike") <= min(BUCKET_ROWS, int(total // shards * LARGE))
    bucket = F.pmod(F.when(whole, F.xxhash64("group", F.lit("slot"))).otherwise(F.xxhash64("row", F.lit("slot"))), F.lit(buckets))
    labelled = labelled.withColumns(
        {
            "_part": F.coalesce(F.col("shard"), F.lit(shards)),
            "_bucket": bucket + F.when(F.col("alike") >= FIRM, 0).otherwise(buckets),
        }
    )
    sizes = labelled.groupBy("_part", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part", "_bucket").orderBy("group", "row")) - 1
    ranked = labelled.withColumn("_rank", within).join(offsets, ["_part", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_offset"))

    found = {r["_part"]: r["n"] for r in labelled.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    kept = [min(found.get(s, 0), quota[s]) for s in range(shards)]
    surplus = [found.get(s, 0) - kept[s] for s in range(shards)]
    upto = [sum(quota[: s + 1]) - sum(kept[: s + 1]) for s in range(shards)]  # vacant slots, summed
    stays = F.col("shard").isNotNull() & (F.col("_rank") < _by_shard(quota))
    pool = F.when(F.col("shard").isNull(), F.col("_rank")).otherwise(
        found.get(shards, 0) + _by_shard([sum(surplus[:s]) for s in range(shards)]) + F.col("_rank") - _by_shard(quota)
    )
    ranked = ranked.withColumns({"_stays": stays, "_pool": pool})
    filled = F.size(F.filter(F.array(*map(F.lit, upto)), lambda x: x <= F.col("_pool")))
    ranked = ranked.withColumn("_to", F.when(F.col("_stays"), F.col("shard")).otherwise(filled))
    first_free = F.element_at(F.array(*(F.lit(kept[s] - (upto[s - 1] if s else 0)) for s in range(shards))), F.col("_to") + 1)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_to").cast("int").alias("shard"),
        F.when(F.col("_stays"), F.col("_rank")).otherwise(first_free + F.col("_pool")).cast("long").alias("slot"),
        F.col("shard").isNotNull().alias("linked"),
        "group",
    )
