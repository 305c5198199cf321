"""Sharding over fixed virtual slots.

Every record is hashed by its id into one of ``SLOTS`` virtual slots.  Bytes and rows are
summed per slot, and a versioned map gives every slot its shard.  The first version fills
the shards from the heaviest slot down, each into the lightest shard so far, so the shards'
bytes are near equal (the law ``bytes``).  Later versions edit the map: ``rebalance`` moves
slots, and only slots, out of shards above the mean, so most records stay where they are.

Scale: one shuffle of (slot, size) partial sums, of at most ``SLOTS`` rows a task; the map
has ``SLOTS`` rows however large the corpus is, and is broadcast.  Ids are hashed, so a group
of equal texts or a source that holds a third of all rows is spread like any other rows; the
position in a shard is counted inside slots, in parallel, and shifted by the rows of the
shard's earlier slots.

Edge cases: a null text has no bytes and weighs 1, as an empty one; rows of a null id are hashed
by their text; equal rows are all kept, in one slot, and so are rows of one id, which are numbered
together; a text as long as a shard makes its shard the heaviest; ties of weight go to the smallest
slot and shard.  An empty table has a map of empty slots and no rows.  Of the caller's columns
those of the names that are added are replaced, and all others kept.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import shared_folder, unused

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def with_slots(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds virtual_slot and size (UTF-8 bytes of the text, plus 1); columns of these names are replaced."""
    name = F.when(docs[key].isNotNull(), F.xxhash64(F.lit("slot"), docs[key])).otherwise(F.xxhash64(F.lit("null"), docs[text]))
    return docs.withColumns({
        "virtual_slot": F.pmod(name, F.lit(slots)).cast("int"),
        "size": F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1,
    })


def weigh(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any; at most as many entries as there are slots."""
    sums = docs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r.virtual_slot: (r.bytes, r.rows) for r in sums}


def assign(weights: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The first map: the heaviest slot first, each into the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda k: (-weights.get(k, (0, 0))[0], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, (0, 0))[0], shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The map edited for new weights or more shards: a slot moves from the heaviest shard to the lightest while that helps."""
    out = {k: s for k, s in old.items() if s < shards}
    loads = dict.fromkeys(range(shards), 0)
    members: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for k, s in out.items():
        loads[s] += weights.get(k, (0, 0))[0]
        members[s].append((weights.get(k, (0, 0))[0], k))
    for k in sorted(set(old) - set(out), key=lambda k: (-weights.get(k, (0, 0))[0], k)):  # of shards that are gone
        s = min(loads, key=lambda s: (loads[s], s))
        out[k] = s
        loads[s] += weights.get(k, (0, 0))[0]
        members[s].append((weights.get(k, (0, 0))[0], k))
    for _ in range(len(old)):
        high, low = max(loads, key=lambda s: (loads[s], -s)), min(loads, key=lambda s: (loads[s], s))
        fitting = [x for x in members[high] if 0 < x[0] < loads[high] - loads[low]]
        if not fitting:
            break
        w, k = min(fitting, key=lambda x: (abs(x[0] - (loads[high] - loads[low]) / 2), x[1]))
        members[high].remove((w, k))
        members[low].append((w, k))
        out[k] = low
        loads[high] -= w
        loads[low] += w
    return out


def map_table(spark: SparkSession, version: int, slot_to_shard: dict[int, int], weights: dict[int, tuple[int, int]]) -> DataFrame:
    rows = [(version, k, s, *weights.get(k, (0, 0))) for k, s in sorted(slot_to_shard.items())]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(slot_map: DataFrame, folder: str | None = None) -> str:
    """Appends a version to the stored map; versions that are there stay."""
    folder = folder or f"{shared_folder(slot_map.sparkSession)}/slot-map"
    slot_map.write.mode("append").partitionBy("version").parquet(folder)
    return folder


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def place(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows and columns, with shard and position (the row's place in its shard, without gaps from 0, by slot and id); columns of these names are replaced."""
    docs = docs.drop("shard", "position")
    before, within = unused("before", docs.columns), unused("within", docs.columns)
    ahead = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_map = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias(before))
    order = Window.partitionBy("virtual_slot").orderBy(docs[key], docs["size"])
    numbered = docs.withColumn(within, F.row_number().over(order))
    return (
        numbered.join(F.broadcast(slot_map), "virtual_slot")  # as many rows as there are slots
        .withColumn("position", F.col(before) + F.col(within) - 1)
        .drop(before, within)
    )


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with virtual_slot, size, shard and position, by a first map of these rows; columns of these names are replaced."""
    docs = with_slots(docs, slots, key, text)
    weights = weigh(docs)
    slot_map = map_table(docs.sparkSession, 1, assign(weights, shards, slots), weights)
    return place(docs, slot_map, key)
