"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``ring_slots`` equal arcs.  ``virtual_nodes`` points per shard fall on
it; an arc belongs to the shard of the next point clockwise, and its further
choices are the other shards in clockwise order.  A shard takes no more than its
bound.  Keys go round by round: in round r every arc offers what is left of it to
its r-th choice, arcs in ring order.  So a key leaves its own shard only where that
is full, and the loads are bounded for certain.

Only the number of rows per arc (at most ``ring_slots`` numbers, however large the
table) comes to the driver; the resulting plan goes back as a literal of bounded
size.  Rows that agree in id, checksum and size are counted first and numbered as one
(in their arc, or on large tables in a part of it); then they are spread again in pieces of ``PIECE`` rows, so
no number of equal rows meets in one task.

Edge cases: a null text has 0 bytes (size 1, checksum 0); null ids and repeated
rows are placed like others (the key is id, checksum and size together, so equal
ids do not pile up); of very long texts only the size and checksum move; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_M = (1 << 64) - 1
#: Rows of a part of an arc that are numbered in one task, about, and equal rows that one task spreads.
PART_ROWS = 1 << 20
PIECE = 1 << 16


def _point(shard: int, replica: int) -> int:
    """A point of the ring for a virtual node (splitmix64 of its number)."""
    x = (shard * 0x9E3779B97F4A7C15 + replica * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def preferences(n_shards: int, virtual_nodes: int, ring_slots: int) -> list[list[int]]:
    """For every arc all shards, in the order in which the ring meets them clockwise."""
    points = sorted((_point(s, v) * ring_slots >> 64, _point(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))
    order = [s for _, _, s in points]
    out, at = [], 0
    for arc in range(ring_slots):
        while at < len(points) and points[at][0] < arc:
            at += 1
        seen: dict[int, None] = {}
        for k in range(len(order)):
            seen.setdefault(order[(at + k) % len(order)])
            if len(seen) == n_shards:
                break
        out.append(list(seen))
    return out


def bounds(total: int, n_shards: int, slack: float) -> list[int]:
    """How many rows each shard takes at most; with no slack the counts differ by one at most."""
    if slack > 0:
        return [-int(-(1 + slack) * total // n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def fill(counts: dict[int, int], prefer: list[list[int]], room: list[int]) -> list[list[dict]]:
    """Per arc the pieces [lo, hi) of its rows, each with a shard and the first place there."""
    left, room = dict(counts), list(room)
    taken = [0] * len(room)
    plan: list[list[dict]] = [[] for _ in prefer]
    used = {arc: 0 for arc in counts}
    for r in range(len(room)):
        for arc in sorted(left):
            n = min(left[arc], room[s := prefer[arc][r]])
            if n:
                plan[arc].append({"lo": used[arc], "hi": used[arc] + n, "shard": s, "base": taken[s]})
                used[arc] += n
                left[arc] -= n
                room[s] -= n
                taken[s] += n
        left = {arc: n for arc, n in left.items() if n}
    return plan


def _arc(ring_slots: int) -> Column:
    bits = ring_slots.bit_length() - 1
    return F.shiftrightunsigned(F.col("_h"), 64 - bits).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 8, virtual_nodes: int = 64, ring_slots: int = 4096, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and one), text_crc32, shard, slot (0, 1, .. within the shard), home (the shard the ring alone gives)."""
    if n_shards < 1 or virtual_nodes < 1 or ring_slots < 2 or ring_slots & (ring_slots - 1):
        raise ValueError("n_shards and virtual_nodes must be positive, ring_slots a power of two")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    keyed = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = keyed.withColumn("_h", F.xxhash64("_id", "text_crc32", "size")).withColumn("_arc", _arc(ring_slots))
    same = keyed.groupBy("_arc", "_h", "_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))  # combined where they are read
    counts = {r["_arc"]: r["n"] for r in keyed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # ring_slots rows at most
    total = sum(counts.values())
    prefer = preferences(n_shards, virtual_nodes, ring_slots)
    plan = fill(counts, prefer, bounds(total, n_shards, slack))
    table = F.from_json(F.lit(json.dumps(plan)), "array<array<struct<lo:long,hi:long,shard:int,base:long>>>")
    home = F.from_json(F.lit(json.dumps([p[0] for p in prefer])), "array<int>")
    # the further bits of the hash cut an arc into parts, in the order of the hash
    arc_bits = ring_slots.bit_length() - 1
    part_bits = min(24, max(0, math.ceil(math.log2(max(1, total) / ring_slots / PART_ROWS))))
    part = F.shiftrightunsigned(F.shiftleft(F.col("_h"), arc_bits), 64 - part_bits).cast("int") if part_bits else F.lit(0)
    same = same.withColumn("_part", part)
    own = Window.partitionBy("_arc", "_part").orderBy("_h", "_id", "text_crc32", "size")
    ranked = same.withColumn("_first", F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.withColumn("_first", F.coalesce("_first", F.lit(0)))
    if part_bits:
        sizes = same.groupBy("_arc", "_part").agg(F.sum("_n").alias("_m"))
        before = sizes.select("_arc", "_part", F.coalesce(F.sum("_m").over(Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        ranked = ranked.join(before, ["_arc", "_part"]).withColumn("_first", F.col("_first") + F.col("_before"))
    # equal rows again one by one: those of large groups in pieces that are dealt out anew
    zero = F.lit(0).cast("long")
    step = lambda n: F.explode(F.sequence(zero, n - 1)).alias("_k")
    columns = ["_arc", "_id", "size", "text_crc32"]
    few = ranked.where(F.col("_n") <= PIECE).select(*columns, "_first", step(F.col("_n")))
    pieces = ranked.where(F.col("_n") > PIECE).select(*columns, "_first", "_n", step(F.ceil(F.col("_n") / PIECE)))
    pieces = pieces.select(*columns, (F.col("_first") + F.col("_k") * PIECE).alias("_first"), F.least(F.lit(PIECE).cast("long"), F.col("_n") - F.col("_k") * PIECE).alias("_n"))
    many = pieces.repartition("_first").select(*columns, "_first", step(F.col("_n")))
    placed = few.unionByName(many).withColumn("_rank", F.col("_first") + F.col("_k"))
    piece = F.filter(F.element_at(table, F.col("_arc") + 1), lambda p: (p["lo"] <= F.col("_rank")) & (F.col("_rank") < p["hi"]))[0]
    placed = placed.withColumn("_piece", piece)
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32",
        F.col("_piece.shard").alias("shard"),
        (F.col("_piece.base") + F.col("_rank") - F.col("_piece.lo")).alias("slot"),
        F.element_at(home, F.col("_arc") + 1).alias("home"),
    )
