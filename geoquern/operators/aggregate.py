"""Spatial aggregates in two phases: partial results per task, then one small merge per group."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import codec, route
from ..functions.areal import union_all
from ..functions.formats import encode_tile
from ..functions.register import call


def extents(df: DataFrame, keys: list[str], box: str = "bbox") -> DataFrame:
    """minx, miny, maxx, maxy per group from box columns (map-side combined, no Python)."""
    return df.groupBy(*keys).agg(F.min(f"{box}.minx").alias("minx"), F.min(f"{box}.miny").alias("miny"), F.max(f"{box}.maxx").alias("maxx"), F.max(f"{box}.maxy").alias("maxy"))


def extent(df: DataFrame, keys: list[str], box: str = "bbox") -> DataFrame:
    """``extent`` per group as a polygon value."""
    e = extents(df, keys, box)
    return e.select(*keys, call("ST_MakeEnvelope", *(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))).alias("extent"))


def dissolve(df: DataFrame, key: str, geom: str = "geom", batch: int = 256, salts: int = 16) -> DataFrame:
    """``geom`` per key: the union of its areas (or points).

    Tasks first dissolve what they hold of a key, in batches; a key's partial results then meet in
    ``salts`` groups, and these in one: what a group holds shrinks with every step."""
    kind = dict(df.dtypes)[key]
    own = df.where(F.col(geom).isNotNull()).select(F.col(key).alias("k"), F.col(geom).alias("g"))

    def merged(values):
        return codec.encode(union_all([codec.decode(v) for v in dict.fromkeys(values)]))  # equal members count once

    def partial(batches):
        held: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = held.setdefault(k, [])
                some.append(g)
                if len(some) >= batch:
                    held[k] = [merged(some)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([merged(v) for v in held.values()], pa.binary())], names=["k", "g"])

    def final(table: pa.Table) -> pa.Table:
        return pa.table({"k": table["k"].combine_chunks().slice(0, 1), "g": pa.array([merged(table["g"].to_pylist())], pa.binary())})

    some = own.mapInArrow(partial, f"k {kind}, g binary").withColumn("s", F.pmod(F.xxhash64("g"), F.lit(salts)))
    some = some.groupBy("k", "s").applyInArrow(final, f"k {kind}, g binary")
    return some.groupBy("k").applyInArrow(final, f"k {kind}, g binary").select(F.col("k").alias(key), F.col("g").alias(geom))


def tiles(df: DataFrame, keys: list[str], geom: str, properties: list[str], order: str, name: str = "default", extent: int = 4096) -> DataFrame:
    """``tile`` per group of features in tile coordinates, features in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(geom).alias("g"), F.to_json(F.struct(*properties)).alias("p"))))

    def encode(column: pa.Array) -> pa.Array:
        out = []
        for group in column.to_pylist():
            features = [(codec.decode(r["g"]), json.loads(r["p"] or "{}")) for r in group if r["g"] is not None]
            out.append(encode_tile(features, name, extent) if features else None)
        return pa.array(out, pa.binary())

    tile = F.arrow_udf(encode, "binary")
    return df.groupBy(*keys).agg(rows.alias("_f")).select(*keys, tile(F.col("_f")).alias("tile"))


EDGE = ("id", "source", "target", "cost")
PATH = "array<struct<seq:int,node:bigint,edge:bigint,cost:double,agg_cost:double>>"
REACH = "array<struct<seq:int,depth:int,start_vid:bigint,pred:bigint,node:bigint,edge:bigint,cost:double,agg_cost:double>>"


def shortest_paths(edges: DataFrame, requests: DataFrame, group: str, reverse: str | None = None) -> DataFrame:
    """``path`` (array of steps) for each request (group, start_vid, end_vid) over the edges of its group.

    The edges of a group form one graph in one task; requests of a group share it."""
    cols = [F.col(c) for c in EDGE] + ([F.col(reverse).alias("back")] if reverse else [])
    graphs = edges.groupBy(group).agg(F.collect_list(F.struct(*cols)).alias("_e"))
    wanted = requests.groupBy(group).agg(F.collect_list(F.struct("start_vid", "end_vid")).alias("_r"))

    def run(e: pa.Array, r: pa.Array) -> pa.Array:
        names = ("seq", "node", "edge", "cost", "agg_cost")
        out = []
        for k, asked in enumerate(r.to_pylist()):
            rows = e[k].values
            parts = {f.name: rows.field(f.name) for f in rows.type}
            whole = pc.and_(pc.and_(pc.is_valid(parts["id"]), pc.is_valid(parts["source"])), pc.and_(pc.is_valid(parts["target"]), pc.is_valid(parts["cost"])))
            column = lambda c, own=parts, some=whole: own[c].filter(some).to_numpy(zero_copy_only=False)
            graph = route.Graph(*(column(c) for c in EDGE), column("back") if reverse is not None else None)
            paths = route.shortest_path_many(graph, [(q["start_vid"], q["end_vid"]) for q in asked])
            out.append([{**q, "path": None if p is None else [dict(zip(names, x, strict=True)) for x in p]} for q, p in zip(asked, paths, strict=True)])
        return pa.array(out, RESULT)

    step = pa.struct([("seq", pa.int32()), ("node", pa.int64()), ("edge", pa.int64()), ("cost", pa.float64()), ("agg_cost", pa.float64())])
    RESULT = pa.list_(pa.struct([("start_vid", pa.int64()), ("end_vid", pa.int64()), ("path", pa.list_(step))]))
    f = F.arrow_udf(run, f"array<struct<start_vid:bigint,end_vid:bigint,path:{PATH}>>")
    return graphs.join(wanted, group).select(group, F.inline(f("_e", "_r")))


def bounded_costs(edges: DataFrame, start: int, limit: float, rounds: int | None = None, reverse: str | None = None, steps: bool = False) -> DataFrame:
    """node, agg_cost of the nodes within ``limit`` of ``start``; with ``steps`` also pred, edge and cost of the step that
    reaches a node (null, -1 and 0 at the start).  ``reverse`` names the column of costs back.

    Rounds of relaxation as joins, for graphs too large for one task, until no cost falls (with ``rounds``: an error if
    more are needed).  Every round is written to the checkpoint folder."""
    spark = edges.sparkSession
    arc = lambda u, v, w: edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.col(w).cast("double").alias("w"), (F.col("id") if "id" in edges.columns else F.lit(0)).cast("long").alias("edge"))
    arcs = arc("source", "target", "cost")
    if reverse is not None:
        arcs = arcs.unionByName(arc("target", "source", reverse))
    arcs = arcs.where(F.col("w") >= 0).groupBy("u", "v").agg(F.min(F.struct("w", "edge")).alias("arc"))
    best = spark.range(1).select(F.lit(int(start)).cast("long").alias("node"), F.struct(F.lit(0.0).alias("agg_cost"), F.lit(None).cast("long").alias("pred"), F.lit(-1).cast("long").alias("edge"), F.lit(0.0).alias("cost")).alias("way"))
    front = best
    done = 0
    while not front.isEmpty():
        if done == rounds:
            raise ValueError(f"costs still fall after {rounds} rounds")
        done += 1
        way = F.struct((F.col("way.agg_cost") + F.col("arc.w")).alias("agg_cost"), F.col("node").alias("pred"), F.col("arc.edge").alias("edge"), F.col("arc.w").alias("cost"))
        new = front.join(arcs, front["node"] == arcs["u"]).select(F.col("v").alias("to"), way.alias("new")).where(F.col("new.agg_cost") <= limit).groupBy("to").agg(F.min("new").alias("new"))
        falls = F.col("way").isNull() | (F.col("new.agg_cost") < F.col("way.agg_cost"))
        merged = best.join(new, F.col("node") == F.col("to"), "full").select(F.coalesce("node", "to").alias("node"), F.coalesce(falls, F.lit(False)).alias("fell"), F.when(falls, F.col("new")).otherwise(F.col("way")).alias("way")).checkpoint()
        front, best = merged.where("fell").select("node", "way"), merged.select("node", "way")
    out = best.select("node", "way.agg_cost", "way.pred", "way.edge", "way.cost")
    return out if steps else out.select("node", "agg_cost")


__all__ = ["bounded_costs", "dissolve", "extent", "extents", "shortest_paths", "tiles"]
