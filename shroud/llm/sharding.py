"""Balanced shards by label propagation.

Nodes are rows, edges link rows that should stay together. Every node starts in a shard by hash. In a round, each
node sees how many neighbours each shard holds (a join of edges and labels, counted before the shuffle), and wants to
go where most are. Each node has its turn in one of two rounds, drawn anew for every two, and of two neighbours that wish for each other's shard
in the same round only one moves, so that ends of an edge don't swap for ever. How many may move from one shard to another is a quota: wishes in
opposite directions cancel, and nodes without neighbours give up their place to those that gain, so a shard never grows
beyond (1 + slack) times the mean. The quotas come from a matrix of shards by shards, the only thing that the driver sees. Which wishes are granted is
decided by a hash, without any sort. Rounds end when no node would gain, or two in a row move next to nothing (``STILL``); ``ROUNDS`` bounds them.

Then the quotas' slack is taken back (``settle``), so that counts differ by one at most: a group stays where propagation has brought most of it, as long as the shard's exact share of rows holds
it; groups beyond that go whole into room that other shards have left. Rows without neighbours stay where they are as far as there is room, and only those beyond it move.
Only a group that meets a border of two shards' room is cut, at most one for each border, and groups larger than a shard.

Edges of equal texts: a star around the least row of each group; a group larger than a shard is first split by hash into
stars that fit one, since it has to be cut anyway.

Null texts belong to no group and weigh one byte. Null and repeated ids are rows like others; an empty table gives an
empty result. Columns that the documents have besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut

SHARDS = 16
ROUNDS = 24
SLACK = 0.02
#: Rounds end when two in a row move less than this share of the linked nodes.
STILL = 0.001
_GRAIN = 1_000_000


def quotas(wishes: np.ndarray, idle: np.ndarray, sizes: np.ndarray, capacity: float) -> tuple[np.ndarray, np.ndarray]:
    """Moves allowed from shard to shard: of nodes that wish so, and of nodes that are free to go anywhere."""
    k = len(sizes)
    granted, freed = np.zeros((k, k)), np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1, k):
            granted[i, j] = granted[j, i] = min(wishes[i, j], wishes[j, i])
    left, idle, sizes = wishes - granted, idle.astype(float).copy(), sizes.astype(float).copy()
    for j in range(k):  # what one shard may still take in, shared among those that wish to come
        want = left[:, j].sum()
        if want <= 0:
            continue
        room = min(want, idle[j] + max(0.0, capacity - sizes[j]))
        part = left[:, j] * (room / want)
        out = max(0.0, room - max(0.0, capacity - sizes[j]))
        granted[:, j] += part
        freed[j] += part * (out / room if room else 0)
        idle[j] -= out
        sizes[j] += room - out
        sizes -= part * (1 - (out / room if room else 0))
    return granted, freed


def yielded(state: DataFrame, both: DataFrame, r: int) -> DataFrame:
    """``state`` without the wishes of nodes that a neighbour with a higher draw would swap shards with."""
    moving = lambda x: state.where("want is not null").select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("want").alias(f"w{x}"))
    draw = lambda x: F.struct(F.xxhash64(x, F.lit("yield"), F.lit(r)), F.col(x))
    swaps = both.join(moving("src"), "src").join(moving("dst"), "dst").where("wsrc = ldst and wdst = lsrc")
    waits = swaps.where(draw("src") < draw("dst")).select(F.col("src").alias("node")).distinct().withColumn("waits", F.lit(True))
    out = state.join(waits, "node", "left").select("node", "linked", "label", F.when(F.col("waits").isNull(), F.col("want")).alias("want"))
    return cut(out, "granted")


def propagate(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """node, linked, label. ``nodes``: node long; ``edges``: src, dst, once for each pair."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst"), "edges")
    linked = both.select(F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True))
    labels = cut(nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("label")), "labels")
    least = STILL * labels.where("linked").count()
    quiet = 0
    for r in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("vote")), "dst").groupBy("src", "vote").count()
        want = votes.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("count", F.lit(-1) * F.col("vote"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("vote", "count"))).alias("votes"))
        turn = F.pmod(F.xxhash64("node", F.lit("turn"), F.lit(r // 2)), F.lit(2)) == r % 2
        gains = F.col("top.count") > F.coalesce(F.element_at("votes", F.col("label")), F.lit(0))
        state = cut(labels.join(want, "node", "left").select("node", "linked", "label", F.when(gains, -F.col("top.col2")).cast("int").alias("wish"), turn.alias("turn")), "wishes")
        if state.where("wish is not null").isEmpty():  # every node is where most of its neighbours are
            break
        state = yielded(state.select("node", "linked", "label", F.when(F.col("turn"), F.col("wish")).alias("want")), both, r)
        wishes, idle, sizes = np.zeros((shards, shards)), np.zeros(shards), np.zeros(shards)
        for row in state.groupBy("label", "want", "linked").count().collect():
            sizes[row["label"]] += row["count"]
            if row["want"] is not None:
                wishes[row["label"], row["want"]] += row["count"]
            elif not row["linked"]:
                idle[row["label"]] += row["count"]
        granted, freed = quotas(wishes, idle, sizes, sizes.sum() / shards * (1 + slack))
        if granted.sum() > 0:
            share = lambda a, b: [[float(x) for x in r] for r in np.divide(a, b, out=np.zeros_like(a), where=b > 0)]
            take = F.array(*(F.array(*map(F.lit, row)) for row in share(granted, wishes)))
            bounds = np.cumsum(np.array(share(freed, np.repeat(idle[:, None], shards, 1))), axis=1)
            leave = F.array(*(F.array(*map(F.lit, map(float, row))) for row in bounds))
            draw = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(_GRAIN)) / float(_GRAIN)
            moved = F.when(F.col("want").isNotNull() & (draw < F.element_at(F.element_at(take, F.col("label") + 1), F.col("want") + 1)), F.col("want"))
            to = F.size(F.filter(F.element_at(leave, F.col("label") + 1), lambda x: x <= F.col("draw")))
            moved = F.coalesce(moved, F.when(~F.col("linked") & (to < shards), to), F.col("label"))
            labels = cut(state.withColumn("draw", draw).select("node", "linked", moved.cast("int").alias("label")), "labels")
        quiet = quiet + 1 if granted.sum() <= least else 0
        if quiet > 1 and r % 2:
            break
    return labels


def cut_edges(edges: DataFrame, labels: DataFrame, label: str = "label") -> int:
    """How many edges join nodes of different shards."""
    at = lambda x: labels.select(F.col("node").alias(x), F.col(label).alias(f"l{x}"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").where("lsrc <> ldst").count()


def ranked(df: DataFrame, order: list[str], weight: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the sum of the weights (1 each, if none is named) of the rows before it in a total order: a range-partitioned sort, running
    sums inside the partitions, and one sum a partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            own = np.ones(len(b), np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = done + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(ends - own), pa.array(ends)], names=[*b.schema.names, "_part", "_at", "_end"])
            done = int(ends[-1]) if len(b) else done

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_end", T.LongType())])
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranked")
    sums = placed.groupBy("_part").agg(F.max("_end").alias("sum"))  # a row for each partition
    before = sums.select("_part", F.coalesce(F.sum("sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_end", "_before")


def _constants(values) -> Column:
    return F.array(*(F.lit(int(x)) for x in values))


def _within(at: Column, ends: np.ndarray) -> Column:
    """Index of the first of rising ends that is beyond the place."""
    return F.size(F.filter(_constants(ends), lambda e: e <= at))


def settle(members: DataFrame, labels: DataFrame, shards: int = SHARDS) -> DataFrame:
    """node, shard for every node: counts one apart at most, and groups whole where they fit. ``members``: node, group (a long)."""
    n = labels.count()
    share = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    votes = members.join(labels.select("node", "label"), "node").groupBy("group", "label").count()
    groups = votes.groupBy("group").agg(F.max(F.struct("count", -F.col("label"))).alias("top"), F.sum("count").alias("size"))
    groups = groups.select("group", "size", (-F.col("top.col2")).cast("int").alias("label"), F.xxhash64("group").alias("turn"))
    groups = cut(ranked(groups, ["label", "turn", "group"], "size", "at"), "groups")

    def total(df: DataFrame, by: str) -> np.ndarray:
        out = np.zeros(shards, np.int64)
        for row in df.groupBy(by).agg(F.sum("size").alias("size")).collect():  # one row a shard
            out[row[by]] = row["size"]
        return out

    base = np.concatenate([[0], np.cumsum(total(groups, "label"))])
    end = F.col("at") + F.col("size") - F.element_at(_constants(base), F.col("label") + 1)
    stays = groups.where(end <= F.element_at(_constants(share), F.col("label") + 1)).select("group", "size", F.col("label").alias("shard"))
    free = share - total(stays, "shard")
    # groups that their shard can't hold are laid along the room of all shards
    over = groups.join(stays.select("group"), "group", "left_anti").select("group", "size", (-F.col("size")).alias("turn"))
    over = cut(ranked(over, ["turn", "group"], "size", "at"), "over")
    ends = np.cumsum(free)
    goes = over.withColumn("shard", _within(F.col("at"), ends)).where(F.col("shard") == _within(F.col("at") + F.col("size") - 1, ends)).select("group", "size", "shard")
    whole = cut(stays.select("group", "shard", "size").union(goes.select("group", "shard", "size")), "whole")
    free = share - total(whole, "shard")
    known = members.join(whole.select("group", "shard"), "group", "left")
    sure = known.where("shard is not null").select("node", F.col("shard").cast("int").alias("shard"))
    rest = cut(labels.join(known.select("node", "group", F.col("shard").alias("_shard")), "node", "left").where("_shard is null").select("node", "group", "label"), "rest")
    # rows of groups at a border go to the widest room
    order = np.argsort(-free, kind="stable")
    along = lambda at, room: F.element_at(_constants(order), _within(at, np.cumsum(room[order])) + 1).cast("int")
    border = cut(ranked(rest.where("group is not null"), ["group", "node"], None, "at").select("node", along(F.col("at"), free).alias("shard"), F.lit(1).alias("size")), "border")
    free = free - total(border, "shard")
    # rows without a group stay where they are as far as there is room; only those beyond it move
    loose = cut(ranked(rest.where("group is null").select("node", "label", F.lit(1).alias("size")), ["label", "node"], None, "at"), "loose")
    count = total(loose, "label")
    within = F.col("at") - F.element_at(_constants(np.cumsum(count) - count), F.col("label") + 1)
    here = within < F.element_at(_constants(free), F.col("label") + 1)
    beyond = ranked(loose.where(~here).select("node", "label"), ["label", "node"], None, "at")
    left = free - np.minimum(free, count)
    order = np.argsort(-left, kind="stable")
    moved = beyond.select("node", along(F.col("at"), left).alias("shard"))
    return cut(sure.union(border.select("node", "shard")).union(loose.where(here).select("node", F.col("label").alias("shard"))).union(moved), "settled")


def stars(rows: DataFrame, part: int) -> DataFrame:
    """node, group (the least node of its star), group_size, of rows whose digest is there more than once."""
    sizes = cut(rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    pieces = F.when(F.col("group_size") <= part, F.lit(1)).otherwise(F.ceil(F.col("group_size") / (0.8 * part)))
    members = cut(rows.select("node", "digest").join(sizes, "digest").withColumn("star", F.pmod(F.xxhash64("node"), pieces)), "members")
    centres = cut(members.groupBy("digest", "star").agg(F.min("node").alias("group")), "stars")
    return cut(members.join(centres, ["digest", "star"]).select("node", "group", "group_size"), "starred")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard, group_size; equal texts are kept together."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5("text").alias("digest"))
    rows = cut(rows, "rows")
    n = rows.count()
    members = stars(rows, max(1, n // shards))
    edges = members.select(F.col("node").alias("src"), F.col("group").alias("dst")).where("src <> dst")
    shard = settle(members, propagate(rows, edges, shards, rounds), shards)
    out = rows.join(shard, "node").join(members.select("node", "group", "group_size"), "node", "left")
    out = ranked(out, ["shard", "group", "node"])
    first = np.concatenate([[0], np.cumsum([n // shards + (s < n % shards) for s in range(shards)])])
    slot = F.col("rank") - F.element_at(_constants(first), F.col("shard") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
