"""Operator 6: sharding by best-fit-decreasing bin packing.

Documents of equal text form a group that is never split. Groups, largest
first, go to the fullest shard that still has room for them; the shards' room
is kept in a sorted list that is searched by bisection. With a given capacity
this opens a shard only for what fits no other; with a given number of shards the capacity
is the smallest tried for which that many suffice.

What is packed is bounded. For a number of shards: groups larger than 1/``PIECES`` of all bytes
(fewer than ``PIECES``) by themselves, all others in ``PIECES`` bundles chosen by the hash of their
text. For a capacity: groups larger than 1/``PARTS`` of it by themselves, all others in bundles of
about that size, in independent hash ranges of about ``RANGE`` shards each, one task a range (Python);
each range may leave one more shard partly empty than packing all at once would. A bundle over
1/8 of the capacity is taken apart, so only a group larger than the capacity exceeds it.
A bundle is a set of whole groups, so groups stay whole.

Edge cases: a null text has 0 bytes, is not equal to an empty one and has crc32
0; a group larger than a fair share gets a shard of its own and the others share
the rest; repeated rows are rows; without documents there are no shards.
Columns named as those added here are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import small, table
from tidings.session import stage

SHARDS = 8
#: Groups over 1/PIECES of all bytes are packed alone, the rest in PIECES bundles: at most twice as many items to pack.
PIECES = 32768
#: With a capacity: groups over 1/PARTS of it are packed alone, and about RANGE shards by one task, so about 2 * PARTS * RANGE items at most.
PARTS, RANGE = 64, 512
#: Rows numbered together within a shard.
SLOT_ROWS = 10_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ``sizes`` must be in decreasing order. An item goes
    to the bin with the least room that holds it, else to a new bin; one larger
    than ``capacity`` has a bin of its own."""
    room: list[tuple[int, int]] = []  # (free bytes, bin), sorted
    out, bins = [], 0
    for s in sizes:
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b, bins = max(capacity, s), bins, bins + 1
        insort(room, (free - s, b))
        out.append(b)
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing into at most ``shards`` bins of nearly equal size.
    Items above a fair share of what is left take a bin each; the capacity of
    the others is found between their fair share and twice the first that serves."""
    alone = 0
    left = sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    fair = max(-(-left // bins), rest[0])
    low, high = 0, None  # of what the capacity exceeds the fair share by: the last that failed, the least that did
    step, best = 0, None
    while best is None or high - low > max(1, fair // 10_000):
        placed = best_fit_decreasing(rest, fair + step)
        if max(placed) < bins:
            best, high = placed, step
        else:
            low = step
        step = max(2 * step, fair // 10_000, 1) if best is None else (low + high) // 2
        if step == 0:
            break
    return [*range(alone), *(alone + b for b in best)]


def _group(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("-")).otherwise(F.sha2(text, 256))


def _items(sized: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Groups with their item, the items (``item``, ``bytes``; 2 * PIECES at most), and all bytes."""
    groups = stage(sized.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(PIECES)).cast("string"))
    groups = groups.withColumn("item", F.when(F.col("bytes") * PIECES > total, F.concat(F.lit("g"), F.col("_group"))).otherwise(bundle))
    return groups, groups.groupBy("item").agg(F.sum("bytes").alias("bytes")), total


def assign(sized: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """``sized`` (with ``_group`` and ``size``) with ``shard``: a fixed number of
    ``shards``, or the shards of ``capacity`` bytes that best fit decreasing opens."""
    if capacity:
        return _assign_capacity(sized, capacity)
    spark = sized.sparkSession
    groups, items, _ = _items(sized)
    packed = sorted(((r["bytes"], r["item"]) for r in items.collect()), key=lambda x: (-x[0], x[1]))  # bounded: see PIECES
    sizes = [n for n, _ in packed]
    bins = pack_into(sizes, shards or 1)
    where = spark.createDataFrame([(i, b) for (_, i), b in zip(packed, bins, strict=True)], "_item string, shard int")
    large = F.broadcast(where.where("_item LIKE 'g%'").select(F.expr("substr(_item, 2)").alias("_large"), F.col("shard").alias("_alone")))
    bundles = F.broadcast(where.where("_item LIKE 'b%'").select(F.expr("cast(substr(_item, 2) as long)").alias("_b"), F.col("shard").alias("_with")))
    out = sized.drop("shard").join(large, F.col("_group") == F.col("_large"), "left")
    out = out.join(bundles, F.pmod(F.xxhash64("_group"), F.lit(PIECES)) == F.col("_b"), "left")
    return out.withColumn("shard", F.coalesce("_alone", "_with")).drop("_large", "_alone", "_b", "_with")


def _assign_capacity(sized: DataFrame, capacity: int) -> DataFrame:
    """``sized`` with ``shard``, in shards of ``capacity`` bytes."""
    spark = sized.sparkSession
    groups = stage(sized.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    ranges = total // (RANGE * capacity) or 1
    each = -(-total * PARTS // (capacity * ranges)) or 1  # bundles in a range
    bundle = F.pmod(F.xxhash64("_group"), F.lit(ranges * each))
    large = F.col("bytes") * PARTS > capacity
    together = F.sum(F.when(~large, F.col("bytes"))).over(Window.partitionBy("_b"))
    groups = groups.withColumn("_b", bundle).withColumn("_large", F.when(large | (together * 8 > capacity), F.col("_group")))
    items = groups.groupBy("_b", "_large").agg(F.sum("bytes").alias("bytes")).withColumn("_range", F.floor(F.col("_b") / each))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "_b", "_large"], ascending=[False, True, True], kind="stable")
        return part[["_range", "_b", "_large"]].assign(bin=best_fit_decreasing(part["bytes"].tolist(), capacity))

    packed = stage(items.groupBy("_range").applyInPandas(pack, "_range long, _b long, _large string, bin long"), "packed")
    opened = packed.groupBy("_range").agg((F.max("bin") + 1).alias("n")).orderBy("_range").collect()  # one row a range
    before = accumulate((r["n"] for r in opened), initial=0)
    first = spark.createDataFrame([(r["_range"], n) for r, n in zip(opened, before)], "_range long, _first long")
    where = packed.join(F.broadcast(first), "_range").withColumn("shard", (F.col("_first") + F.col("bin")).cast("int"))
    alone = small(where.where("_large IS NOT NULL").select("_large", F.col("shard").alias("_alone")))
    bundles = small(where.where("_large IS NULL").select("_b", F.col("shard").alias("_with")))
    out = sized.drop("shard").withColumn("_b", bundle).join(alone, F.col("_group") == F.col("_large"), "left").join(bundles, "_b", "left")
    return out.withColumn("shard", F.coalesce("_alone", "_with")).drop("_b", "_large", "_alone", "_with")


def with_slots(placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``slot``: position in the shard, gapless from 0. Rows are numbered in
    buckets of a shard of about ``SLOT_ROWS`` rows, each bucket from the number
    of rows in those before it, so neither a shard nor a group lands in one task."""
    key = F.xxhash64(F.col(doc_id), F.col("_group"))
    rows = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = -(-rows // SLOT_ROWS) or 1
    placed = placed.drop("slot").withColumn("_bucket", F.pmod(key, F.lit(buckets)))
    counts = stage(placed.groupBy("shard", "_bucket").count(), "slot-counts")
    before = counts.withColumn("_before", F.sum("count").over(
        Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = small(before.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_k"), F.coalesce("_before", F.lit(0)).alias("_before")))
    at = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(key, F.col(doc_id), "_group")) - 1
    out = placed.withColumn("_at", at).join(before, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_k")), "left")
    return out.withColumn("slot", (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before", "_s", "_k")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(t).cast("long") + 1, "text_crc32": F.crc32(t), "_group": _group(F.col(text))})


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every input row with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    return with_slots(assign(sized(docs, text), shards, capacity), doc_id).drop("_group")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = stage(sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "sizes")
    out = with_slots(assign(narrow, SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
