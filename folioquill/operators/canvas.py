"""Canvas layout: nodes, zones, image sizes, the next free place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GAP = 40
NODES = "array<struct<id:string,type:string,x:int,y:int,width:int,height:int,text:string,file:string,url:string,label:string,color:string>>"
EDGES = "array<struct<id:string,fromNode:string,fromSide:string,toNode:string,toSide:string,label:string,color:string>>"
#: Fixed values: (least aspect ratio, whether the bound itself counts, width, height), widest first; null sizes leave the fallback.
SIZES = ((2.0, False, 440, 220), (1.6, True, 420, 236), (1.2, True, 380, 285), (1.1, False, 320, 240), (0.9, True, 280, 280), (0.6, True, 240, 320), (0.0, True, 200, 356))
PDF, FALLBACK = (400, 520), (320, 240)


def parse(canvases: DataFrame, column: str = "json") -> DataFrame:
    """Adds nodes and edges, parsed from JSON; unreadable text gives nulls."""
    return canvases.withColumn("_c", F.from_json(column, f"nodes {NODES}, edges {EDGES}")).select(*canvases.columns, "_c.nodes", "_c.edges")


def nodes(parsed: DataFrame, key: str = "canvas") -> DataFrame:
    return parsed.select(key, F.inline("nodes"))


def zone_members(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone, id): nodes whose top left corner lies in a zone (half open). Both share the canvas, so the join is by canvas."""
    z = zones.select("canvas", F.col("id").alias("zone"), *[F.col(c).alias(f"z{c}") for c in ("x", "y", "width", "height")])
    inside = (F.col("x") >= F.col("zx")) & (F.col("x") < F.col("zx") + F.col("zwidth")) & (F.col("y") >= F.col("zy")) & (F.col("y") < F.col("zy") + F.col("zheight"))
    return nodes.join(z, "canvas").where(inside & (F.col("id") != F.col("zone"))).select("canvas", "zone", "id")


def next_position(nodes: DataFrame, zones: DataFrame, width: int, padding: int = 0) -> DataFrame:
    """(canvas, zone, x, y) for a node of this width: right of the zone's rightmost node, aligned to its top row, else below all.

    nodes: (canvas, id, type, x, y, width, height); zones: group nodes (canvas, id, x, y, width, height). ``padding``
    is what a zone keeps free at its right edge. An empty zone takes the node at its corner.
    """
    inside = zone_members(nodes.where("type <> 'group'"), zones).join(nodes, ["canvas", "id"])
    m = inside.groupBy("canvas", "zone").agg(F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.min("y").alias("top"))
    z = zones.select("canvas", F.col("id").alias("zone"), "x", "y", F.col("width").alias("w")).join(m, ["canvas", "zone"], "left")
    fits = F.col("right") + GAP + width <= F.col("x") + F.col("w") - padding
    empty = F.col("right").isNull()
    return z.select(
        "canvas", "zone", F.when(~empty & fits, F.col("right") + GAP).otherwise(F.col("x") + 20).cast("long").alias("x"),
        F.when(empty, F.col("y") + 20).when(fits, F.col("top")).otherwise(F.col("bottom") + 20).cast("long").alias("y"))


def default_position(nodes: DataFrame) -> DataFrame:
    """(canvas, x, y) for a node without a zone: below everything."""
    return nodes.groupBy("canvas").agg((F.max(F.col("y") + F.col("height")) + 60).cast("long").alias("y")).select("canvas", F.lit(-400).cast("long").alias("x"), "y")


def image_size(width: Column, height: Column, suffix: Column | None = None) -> Column:
    """(width, height) of an image node by aspect ratio; fixed for PDFs, a fallback for unknown sizes."""
    say = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    ratio = F.try_divide(width, height)
    out = F.when(F.lit(False) if suffix is None else F.lower(suffix) == ".pdf", say(*PDF))
    for least, equal, w, h in SIZES:
        out = out.when((ratio >= least) if equal else (ratio > least), say(w, h))
    return out.otherwise(say(*FALLBACK))
