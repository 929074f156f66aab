"""Resharding by minimum-cost flow: from old shards to new capacities, moving the fewest bytes.

Documents of an old shard form blocks: one that is large by itself, or a hash bucket of small ones. A flow from the
old shards' sizes to the new shards' capacities, where a byte that stays costs nothing, tells how many bytes go where;
whole blocks are then dealt along it, largest first, and what is left uneven is settled by small blocks. Only sizes of
shards and blocks reach the driver, whose number is bounded by parameters; documents stay on Spark.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def cheapest_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Units sent from each source to each sink at the least total cost, by successive cheapest paths; all supply is sent.

    Distances settle by rounds over the whole cost matrix, forth along its edges and back along those that carry flow.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than there is")
    left, room = np.array(supply, dtype=object), np.array(capacity, dtype=object)
    flow = np.zeros(cost.shape, dtype=object)
    cost = cost.astype(float)
    while (left > 0).any():
        near = np.where(left > 0, 0.0, np.inf)
        far = np.full(len(room), np.inf)
        to, back = np.full(len(room), -1), np.full(len(left), -1)
        while True:
            reach = near[:, None] + cost
            best = reach.argmin(0)
            closer = reach.min(0) < far
            far[closer], to[closer] = reach.min(0)[closer], best[closer]
            home = np.where(flow > 0, far[None, :] - cost, np.inf)
            nearer = home.min(1) < near
            if not nearer.any():
                break
            near[nearer], back[nearer] = home.min(1)[nearer], home.argmin(1)[nearer]
        j = int(np.where(room > 0, far, np.inf).argmin())
        path, end = [], j
        while True:
            i = int(to[j])
            path.append((i, j, 1))
            if back[i] < 0:
                break
            path.append((i, int(back[i]), -1))
            j = int(back[i])
        amount = min([left[i], room[end], *[flow[a, b] for a, b, way in path if way < 0]])
        for a, b, way in path:
            flow[a, b] += way * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def deal(blocks: list[tuple[int, int, int]], flow: np.ndarray, old: list[int], even: int) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, block, bytes), so that shards come near to what flows into them.

    Blocks of a shard go, largest first, where most of its flow is still unmet, at equal need where they lie. Then the
    shard that is most over gives the one most under the largest block that is at most half their difference, until
    that is ``even`` or no block is so small.
    """
    target = [int(x) for x in flow.sum(0)]
    row = {s: i for i, s in enumerate(old)}
    need = [{j: flow[i, j] for j in range(len(target)) if flow[i, j] > 0 or j == old[i]} for i in range(len(old))]
    place, over = {}, [-t for t in target]
    for shard, block, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        i = row[shard]
        j = max(need[i], key=lambda j: (need[i][j], j == shard, -j))
        need[i][j] -= size
        over[j] += size
        place[shard, block] = j
    held = defaultdict(list)
    for shard, block, size in blocks:
        held[place[shard, block]].append((size, shard != place[shard, block], shard, block))
    for h in held.values():
        h.sort()
    while True:
        a, b = over.index(max(over)), over.index(min(over))
        gap = over[a] - over[b]
        k = bisect_right(held[a], (gap // 2, True, 1 << 62, 0)) - 1
        if gap <= even or k < 0:
            return place
        size, _, shard, block = held[a].pop(k)
        insort(held[b], (size, shard != b, shard, block))
        over[a] -= size
        over[b] += size
        place[shard, block] = b


def plan(rows: DataFrame, capacities: list[int] | None = None, shards: int = 16, fineness: int = 256, cost: np.ndarray | None = None) -> DataFrame:
    """``rows`` (size, old_shard and a unique row) with ``shard`` and ``slot``, gapless from 0 in each shard.

    A block has at most a ``fineness``-th of a mean shard's bytes or rows, or is one document, so there are at most
    about 4 * ``shards`` * ``fineness``, and two for each old shard; these, with their sizes, are what the driver sees.
    Without ``capacities`` shards share all bytes equally. ``cost`` is (old shards in order) x (new shards), a byte each;
    without it staying under one's number is free and any move costs one. A shard may lie over its capacity by less
    than the smallest blocks are wide.
    """
    spark = rows.sparkSession
    by_shard = {r["old_shard"]: r for r in rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each old shard
    total, count = sum(r["size"] for r in by_shard.values()), sum(r["n"] for r in by_shard.values())
    shards = len(capacities) if capacities else shards
    most, most_rows = max(total // (shards * fineness), 1), max(count // (shards * fineness), 1)
    small = rows.where(F.col("size") <= most).groupBy("old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("size") * 2 / most) + F.ceil(F.col("n") / most_rows)).cast("long")
    buckets = small.select("old_shard", buckets.alias("__buckets"))
    block = F.when(F.col("size") > most, -1 - F.col("row")).otherwise(F.pmod(F.xxhash64("row"), F.col("__buckets")))
    rows = rows.join(F.broadcast(buckets), "old_shard", "left").withColumn("block", block).drop("__buckets")  # a row for each old shard
    blocks = [tuple(r) for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()]
    old = sorted(by_shard)
    if capacities is None:
        capacities = [total // shards + (j < total % shards) for j in range(shards)]
    if cost is None:
        cost = np.array([[0 if i == j else 1 for j in range(shards)] for i in old]).reshape(len(old), shards)
    flow = cheapest_flow([by_shard[i]["size"] for i in old], capacities, cost)
    place = deal([b[:3] for b in blocks], flow, old, total // (shards * fineness * 4))
    offset, table = defaultdict(int), []
    for shard, name, _, n in sorted(blocks):
        j = place[shard, name]
        table.append((shard, name, j, offset[j]))
        offset[j] += n
    placed = spark.createDataFrame(table, "old_shard int, block long, shard int, first long")
    rows = rows.join(F.broadcast(placed), ["old_shard", "block"])  # a row for each block
    slot = F.col("first") + F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("row")) - 1
    return rows.withColumn("slot", slot.cast("long")).drop("first", "block")


def reshard(docs: DataFrame, old: Column, capacities: list[int] | None = None, shards: int = 16, fineness: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard) of every document; ``old`` is its shard by now, a number.

    The law is ``bytes``: sizes, which are UTF-8 bytes and one more, come near to equal. A null text has no bytes; a null
    ``old`` is shard 0; equal texts and repeated rows are documents of their own and may part; a very long text is a block of
    its own, and a shard holds at least that; an empty table gives none; further columns are ignored. Texts are read
    once; their sizes and checksums are written, so that what is planned is what is numbered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    out = plan(rows, capacities, shards, fineness)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite(spark: SparkSession, path: str, capacities: list[int] | None = None, shards: int = 16, fineness: int = 256) -> dict[str, int]:
    """Reshards documents stored at ``path`` as ``shard=<n>`` folders of Parquet files: only files that lose a row are written anew.

    New files are written beside the old, then a journal tells what is to be moved in and what deleted; a run that ends
    early is finished by ``settle``, which the next run calls first. Returns how many files were replaced and written.
    """
    settle(spark, path)
    stored = spark.read.option("recursiveFileLookup", "false").parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = stored.select((F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.col("shard").cast("int").alias("old_shard"), "__file", "__at")
    moves = plan(cut(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes"), capacities, shards, fineness)
    moves = cut(moves.select("__file", "__at", "old_shard", F.col("shard").alias("__to")), "moves")
    touched = moves.where(F.col("old_shard") != F.col("__to")).select("__file").distinct()
    files = [r[0] for r in touched.collect()]  # names of files
    if not files:
        return {"replaced": 0, "written": 0}
    names = [c for c in stored.columns if c not in ("__file", "__at", "shard")]
    part = stored.join(touched, "__file", "left_semi").join(moves, ["__file", "__at"]).select(*names, F.col("__to").alias("shard"))
    stage = f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    part.repartition("shard", F.pmod(F.xxhash64(*names), F.lit(max(1, len(files) // shards)))).write.partitionBy("shard").parquet(stage)
    fs, at = hadoop(spark, path)
    new = []
    for folder in fs.listStatus(at(stage)):
        if folder.getPath().getName().startswith("shard="):
            for f in fs.listStatus(folder.getPath()):
                new.append((f.getPath().toString(), f"{path.rstrip('/')}/{folder.getPath().getName()}/{f.getPath().getName()}"))
    out = fs.create(at(f"{stage}.tmp"), True)
    out.write(bytearray(json.dumps({"add": new, "delete": files, "stage": stage}).encode()))
    out.close()
    fs.rename(at(f"{stage}.tmp"), at(f"{path.rstrip('/')}/_journal"))
    settle(spark, path)
    return {"replaced": len(files), "written": len(new)}


def hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(spark: SparkSession, path: str) -> None:
    """Finishes what a journal at ``path`` tells; each step may be repeated."""
    fs, at = hadoop(spark, path)
    journal = at(f"{path.rstrip('/')}/_journal")
    if not fs.exists(journal):
        return
    told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(journal), "UTF-8"))
    for source, target in told["add"]:
        if fs.exists(at(source)):
            fs.mkdirs(at(target).getParent())
            fs.rename(at(source), at(target))
    for name in told["delete"]:
        fs.delete(at(name), False)
    fs.delete(at(told["stage"]), True)
    fs.delete(journal, False)
