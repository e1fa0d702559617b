"""Spatial joins and gazetteer building on grids.

Polygons are vertex tables ``feature_id, part, ring, seq, lon, lat`` with closed
rings; points are ``point_id, lon, lat``. Points meet the grid cells that a polygon
covers and, where its edges pass, the edges of their own cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.functions.scoring import km
from siftline.sources.scratch import materialize

RING = ("feature_id", "part", "ring")


def edges(vertices: DataFrame) -> DataFrame:
    """Edges of each ring from its vertices."""
    order = Window.partitionBy(*RING).orderBy("seq")
    rows = vertices.withColumn("lon2", F.lead("lon").over(order)).withColumn("lat2", F.lead("lat").over(order))
    return rows.where("lon2 IS NOT NULL").select(*RING, F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")


def covering(vertices: DataFrame, band: float) -> tuple[DataFrame, DataFrame]:
    """Cells of ``band`` degrees that a feature covers, and the edges in each cell.

    ``feature_id, cx, cy, inside, crossed``: whether the cell's middle lies in the
    feature and whether an edge passes; a cell that none passes is inside as a
    whole. Edges come once for each cell they pass.
    """
    e = edges(vertices)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = e.withColumn("cy", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    # the part of the edge in this row of cells; a level edge is there as a whole
    slope = (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    at = lambda y: F.when(F.col("lat1") == F.col("lat2"), F.col("lon1")).otherwise(F.col("lon1") + (y - F.col("lat1")) * slope)
    start, end = at(F.greatest(low, F.col("cy") * band)), at(F.least(high, (F.col("cy") + 1) * band))
    level = F.col("lat1") == F.col("lat2")
    west = F.when(level, F.least("lon1", "lon2")).otherwise(F.least(start, end))
    east = F.when(level, F.greatest("lon1", "lon2")).otherwise(F.greatest(start, end))
    # rounding may put a crossing beside its cell, so the cell next to a near border counts as well
    near = 1e-9
    passed = rows.withColumn("cx", F.explode(F.sequence(F.floor(west / band - near), F.floor(east / band + near))))
    passed = passed.select("feature_id", "cx", "cy", "lon1", "lat1", "lon2", "lat2")
    crossed = passed.select("feature_id", "cx", "cy").distinct().withColumn("crossed", F.lit(True))
    middles = raster(vertices, band).select("feature_id", F.col("row").alias("cy"), F.explode(F.sequence("first", "last")).alias("cx")).withColumn("inside", F.lit(True))
    cells = middles.join(crossed, ["feature_id", "cx", "cy"], "full")
    return cells.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("inside", "crossed")}), passed


def contains(points: DataFrame, vertices: DataFrame, band: float = 0.5) -> DataFrame:
    """Features that contain a point: even-odd over all rings, so holes count.

    Points meet the cells of the features. A cell that no edge passes answers at
    once; in the others a point is in the feature if the middle of the cell is,
    unless the way there, level and then upright, crosses an odd number of the edges
    in the cell. So no point meets more edges than pass its cell, and what a feature
    has of points is dealt by cells.
    """
    cells, passed = covering(vertices, band)
    at = points.select("point_id", "lon", "lat").withColumns({"cx": F.floor(F.col("lon") / band), "cy": F.floor(F.col("lat") / band)})
    whole = at.join(cells.where("NOT crossed"), ["cx", "cy"]).select("point_id", "feature_id")
    # one row a cell with its edges, so points are not multiplied by them
    edged = passed.groupBy("feature_id", "cx", "cy").agg(F.collect_list(F.struct("lon1", "lat1", "lon2", "lat2")).alias("edges"))
    edged = edged.join(cells.where("crossed").drop("crossed"), ["feature_id", "cx", "cy"])
    x, y = (F.col("cx") + 0.5) * band, (F.col("cy") + 0.5) * band

    def turns(e: Column) -> Column:
        on_level = ((e["lat1"] > F.col("lat")) != (e["lat2"] > F.col("lat"))) & ((F.col("lon") < (lon := e["lon1"] + (F.col("lat") - e["lat1"]) * (e["lon2"] - e["lon1"]) / (e["lat2"] - e["lat1"]))) != (x < lon))
        upright = ((e["lon1"] > x) != (e["lon2"] > x)) & ((F.col("lat") < (lat := e["lat1"] + (x - e["lon1"]) * (e["lat2"] - e["lat1"]) / (e["lon2"] - e["lon1"]))) != (y < lat))
        return F.coalesce(on_level, F.lit(False)).cast("int") + F.coalesce(upright, F.lit(False)).cast("int")

    met = at.join(edged, ["cx", "cy"])
    odd = F.aggregate("edges", F.lit(0), lambda n, e: n + turns(e)) % 2 == 1
    return whole.unionByName(met.where(F.col("inside") != odd).select("point_id", "feature_id"))


def ring_area(vertices: DataFrame) -> DataFrame:
    """Unsigned shoelace area of each ring."""
    cross = F.col("lon1") * F.col("lat2") - F.col("lon2") * F.col("lat1")
    return edges(vertices).groupBy(*RING).agg((F.abs(F.sum(cross)) / 2).alias("area"))


def feature_area(vertices: DataFrame) -> DataFrame:
    """Area of the outer rings less the holes."""
    signed = F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))
    return ring_area(vertices).groupBy("feature_id").agg(F.sum(signed).alias("area"))


def smallest_containing(points: DataFrame, vertices: DataFrame, band: float = 0.5) -> DataFrame:
    """Of all features that contain a point the one of least area."""
    return (
        contains(points, vertices, band)
        .join(feature_area(vertices), "feature_id")
        .groupBy("point_id")
        .agg(F.min_by("feature_id", F.struct("area", "feature_id")).alias("feature_id"))
    )


def _to_segment(lon: Column, lat: Column) -> Column:
    """Kilometres from a point to the edge ``lon1, lat1, lon2, lat2``, in the plane at the point's latitude."""
    wide = F.cos(F.radians(lat)) * 111.0
    ax, ay = (F.col("lon1") - lon) * wide, (F.col("lat1") - lat) * 111.0
    dx, dy = (F.col("lon2") - F.col("lon1")) * wide, (F.col("lat2") - F.col("lat1")) * 111.0
    along = F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt((ax + share * dx) * (ax + share * dx) + (ay + share * dy) * (ay + share * dy))


def _nearest(points: DataFrame, found: DataFrame, things: DataFrame, distance: Column, cell: float) -> DataFrame:
    """For points without a feature the nearest of ``things`` (``feature_id`` and a box ``w, e, s, n``).

    Points look around in the nine cells about them; cells double in size for those
    that are not yet sure, until one holds everything, so near points meet few things
    and only points far from all meet many. A distance within one cell's height and
    width, at the latitude of the cells, is surely the least.
    """
    lost = materialize(points.select("point_id", "lon", "lat").join(found.select("point_id"), "point_id", "left_anti"), "nearest-points")
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    out = None
    while cell < 720 and not lost.isEmpty():
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
        at = things.withColumn("cx", span("w", "e")).withColumn("cy", span("s", "n"))
        p = lost.withColumn("o", F.explode(around)).withColumns({"cx": F.floor(F.col("lon") / cell) + F.col("o.x"), "cy": F.floor(F.col("lat") / cell) + F.col("o.y")})
        near = p.join(at, ["cx", "cy"]).groupBy("point_id", "lat").agg(F.min(F.struct(distance.alias("d"), "feature_id")).alias("best"))
        # what lies beyond the nine cells is at least a cell away, in longitude by the shortest degree between the two
        width = F.cos(F.radians(F.least(F.abs("lat") + cell, F.lit(90.0)))) * cell * 111.0
        sure = near.where((F.col("best.d") <= F.least(width, F.lit(cell * 111.0))) | F.lit(cell >= 360)).select("point_id", "best.feature_id")
        sure = materialize(sure, "nearest-sure")
        out = sure if out is None else out.unionByName(sure)
        lost = materialize(lost.join(sure.select("point_id"), "point_id", "left_anti"), "nearest-points")
        cell *= 2
    return out if out is not None else lost.select("point_id", F.lit(None).cast(things.schema["feature_id"].dataType).alias("feature_id"))


def nearest(points: DataFrame, found: DataFrame, anchors: DataFrame, cell: float = 2.0) -> DataFrame:
    """For points without a feature the nearest anchor (``feature_id, lon, lat``)."""
    a = anchors.select("feature_id", F.col("lon").alias("alon"), F.col("lat").alias("alat"), F.col("lon").alias("w"), F.col("lon").alias("e"), F.col("lat").alias("s"), F.col("lat").alias("n"))
    return _nearest(points, found, a, km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")), cell)


def nearest_boundary(points: DataFrame, found: DataFrame, vertices: DataFrame, sea: DataFrame | None = None, cell: float = 2.0) -> DataFrame:
    """For points without a feature the one whose boundary is nearest, ties (to the micrometre) by id; features of ``sea`` (``feature_id``) are no parents."""
    land = vertices if sea is None else vertices.join(sea.select("feature_id").distinct(), "feature_id", "left_anti")
    box = {"w": F.least("lon1", "lon2"), "e": F.greatest("lon1", "lon2"), "s": F.least("lat1", "lat2"), "n": F.greatest("lat1", "lat2")}
    return _nearest(points, found, edges(land).withColumns(box), F.round(_to_segment(F.col("lon"), F.col("lat")), 9), cell)


def majority_parent(samples: DataFrame, vertices: DataFrame, tolerance: float = 0.9, band: float = 0.5) -> DataFrame:
    """Parent of each unit by the share of its sample points (``unit_id, point_id, lon, lat``); near the best the smallest wins."""
    hits = contains(samples.select("point_id", "lon", "lat"), vertices, band).join(samples.select("unit_id", "point_id"), "point_id")
    shares = hits.groupBy("unit_id", "feature_id").agg(F.count(F.lit(1)).alias("n")).join(feature_area(vertices), "feature_id")
    best = shares.withColumn("most", F.max("n").over(Window.partitionBy("unit_id"))).where(F.col("n") >= F.lit(tolerance) * F.col("most"))
    return best.groupBy("unit_id").agg(F.min_by("feature_id", F.struct("area", "feature_id")).alias("feature_id"))


def raster(vertices: DataFrame, step: float) -> DataFrame:
    """``feature_id, row, first, last``: runs of grid cells of ``step`` degrees whose middle lies in a feature, holes left out.

    Every edge crosses the middles of its rows once; between the first and the second,
    the third and the fourth crossing of a row lies the feature. So work and rows grow
    with the edges and the height of a feature, not with its area. A count of cells is
    off its area by at most a cell at either end of each run, and a row at either end.
    """
    behind = lambda c: F.ceil(c / step - 0.5)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = edges(vertices).withColumns({"from": behind(low), "upto": behind(high) - 1}).where("from <= upto")
    rows = rows.withColumn("row", F.explode(F.sequence("from", "upto")))
    at = F.col("lon1") + ((F.col("row") + 0.5) * step - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    crossed = rows.groupBy("feature_id", "row").agg(F.sort_array(F.collect_list(behind(at))).alias("c"))
    runs = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.struct(F.get("c", i).alias("first"), (F.get("c", i + 1) - 1).alias("last")))
    return crossed.where("size(c) > 1").select("feature_id", "row", F.inline(F.filter(runs, lambda r: r["first"] <= r["last"])))


def overlap_cells(units: DataFrame, parents: DataFrame, step: float = 0.01, tile: int = 64) -> DataFrame:
    """``unit_id, feature_id, n``: cells of a unit's grid that lie in a parent; runs meet by row and tile of columns."""

    def tiled(runs: DataFrame) -> DataFrame:
        rows = runs.withColumn("tile", F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor(F.col("last") / tile))))
        return rows.withColumns({"first": F.greatest("first", F.col("tile") * tile), "last": F.least("last", F.col("tile") * tile + tile - 1)})

    ours = tiled(raster(units, step)).withColumnsRenamed({"feature_id": "unit_id", "first": "a", "last": "b"})
    met = ours.join(tiled(raster(parents, step)), ["row", "tile"])
    cells = F.least("b", "last") - F.greatest("a", "first") + 1
    return met.where(cells > 0).groupBy("unit_id", "feature_id").agg(F.sum(cells).alias("n"))


def parents_by_overlap(units: DataFrame, parents: DataFrame, step: float = 0.01, tolerance: float = 0.9) -> DataFrame:
    """Parent of each unit by the area they share, from the polygons alone; near the best the smallest wins."""
    shares = overlap_cells(units, parents, step).join(feature_area(parents), "feature_id")
    best = shares.withColumn("most", F.max("n").over(Window.partitionBy("unit_id"))).where(F.col("n") >= F.lit(tolerance) * F.col("most"))
    return best.groupBy("unit_id").agg(F.min_by("feature_id", F.struct("area", "feature_id")).alias("feature_id"))


def composition(polygons: DataFrame, registry: DataFrame, least_hits: int = 3, least_score: float = 1.0, lead: float = 1.1) -> DataFrame:
    """P5: registry unit of each polygon by the names of its members: hits squared over size, clearly ahead of the next."""
    sizes = registry.groupBy("unit").agg(F.count_distinct("member").alias("size"))
    hits = polygons.select("polygon", "member").distinct().join(registry.select("unit", "member").distinct(), "member").groupBy("polygon", "unit").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.join(sizes, "unit").withColumn("score", F.col("hits") * F.col("hits") / F.col("size"))
    order = Window.partitionBy("polygon").orderBy(F.desc("score"), "unit")
    ranked = scored.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    ok = (F.col("hits") >= least_hits) & (F.col("score") >= least_score) & (F.col("second").isNull() | (F.col("score") >= F.lit(lead) * F.col("second")))
    return ranked.where((F.col("rn") == 1) & ok).select("polygon", "unit", "hits", "score")


def anchor_match(polygons: DataFrame, registry: DataFrame, least_population: int = 5000) -> DataFrame:
    """Unit that has the polygon's most populous member, if that is populous enough and names one unit only."""
    top = polygons.groupBy("polygon").agg(F.max(F.struct("population", "member")).alias("t")).where(F.col("t.population") >= least_population)
    met = top.select("polygon", F.col("t.member").alias("member")).join(registry.select("unit", "member").distinct(), "member")
    return met.groupBy("polygon").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")).where("n = 1").drop("n")


def claim(matches: DataFrame) -> DataFrame:
    """Each unit goes to its best polygon only."""
    order = Window.partitionBy("unit").orderBy(F.desc("score"), "polygon")
    return matches.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def gazetteer(regions: DataFrame, districts: DataFrame, places: DataFrame) -> DataFrame:
    """One zone table of three (``source_id, parent_source, level, name``): unique slugs in order of source, suffixes from the second on, and parents."""
    rows = regions.unionByName(districts, True).unionByName(places, True).withColumn("base", text.slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("level", "source_id"))
    zones = rows.withColumn("zone_id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n))).drop("base")
    zones = materialize(zones, "gazetteer")
    parents = zones.select(F.col("source_id").alias("parent_source"), F.col("zone_id").alias("parent_id"))
    return zones.join(parents, "parent_source", "left").drop("parent_source")


def zone_names(zones: DataFrame) -> DataFrame:
    """``zone_id, norm, kind`` of every variant of a name; the plain key is ``primary``, the others are ``variant``."""
    names = zones.select("zone_id", text.norm_key(F.col("name")).alias("key"), F.explode(text.name_variants(F.col("name"))).alias("norm"))
    return names.select("zone_id", "norm", F.when(F.col("norm") == F.col("key"), "primary").otherwise("variant").alias("kind"))


def orphans(zones: DataFrame) -> DataFrame:
    """Per level its zones and how many of them lack a parent; regions have none."""
    lost = F.col("parent_id").isNull() & (F.col("level") != "region")
    return zones.groupBy("level").agg(F.count(F.lit(1)).alias("zones"), F.count_if(lost).alias("orphans"))


def write_facts(layer: DataFrame, zones: DataFrame) -> DataFrame:
    """A layer's features (``source_id``) with the name, ``zone`` and ``parent`` of their zone; features without one keep what they have."""
    facts = zones.select("source_id", F.col("name").alias("fact_name"), F.col("zone_id").alias("fact_zone"), F.col("parent_id").alias("fact_parent"))
    rows = layer.join(facts, "source_id", "left")
    new = {"name": "fact_name", "zone": "fact_zone", "parent": "fact_parent"}
    kept = {c: F.coalesce(F.col(f), F.col(c)) if c in layer.columns else F.col(f) for c, f in new.items()}
    return rows.withColumns(kept).drop(*new.values())


def share_inside(vertices: DataFrame, regions: DataFrame, least: float = 0.6, band: float = 0.5) -> DataFrame:
    """Features with at least ``least`` of their vertices in some region."""
    points = vertices.select(F.concat_ws("/", "feature_id", "part", "ring", "seq").alias("point_id"), "lon", "lat", F.col("feature_id").alias("own"))
    inside = contains(points.drop("own"), regions, band).select("point_id").distinct().withColumn("inside", F.lit(1.0))
    rows = points.join(inside, "point_id", "left").groupBy(F.col("own").alias("feature_id")).agg(F.round(F.avg(F.coalesce("inside", F.lit(0.0))), 6).alias("share"))
    return rows.where(F.col("share") >= least)


def touching(vertices: DataFrame, regions: DataFrame, band: float = 0.5) -> DataFrame:
    """P10: features with a vertex in a region, or with a region's vertex in them."""
    name = lambda v: v.select(F.concat_ws("/", "feature_id", "part", "ring", "seq").alias("point_id"), "lon", "lat", F.col("feature_id").alias("own"))
    ours = contains(name(vertices).drop("own"), regions, band).join(name(vertices).select("point_id", "own"), "point_id").select(F.col("own").alias("feature_id"))
    return ours.unionByName(contains(name(regions).drop("own"), vertices, band).select("feature_id")).distinct()


def rounded(vertices: DataFrame, precision: int = 3) -> DataFrame:
    """Rounded rings without repeats of the vertex before; rings under three different vertices go, a polygon with its outer ring."""
    rows = vertices.withColumn("lon", F.round("lon", precision)).withColumn("lat", F.round("lat", precision))
    order = Window.partitionBy(*RING).orderBy("seq")
    same = (F.col("lon") == F.lag("lon").over(order)) & (F.col("lat") == F.lag("lat").over(order))
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").drop("same")
    sizes = rows.groupBy(*RING).agg(F.count_distinct("lon", "lat").alias("k"))
    kept = rows.join(sizes.where("k >= 3").drop("k"), list(RING), "left_semi")
    lost = sizes.where("k < 3 AND ring = 0").select("feature_id", "part")
    return kept.join(lost, ["feature_id", "part"], "left_anti")


def without_specks(vertices: DataFrame, least_area: float) -> DataFrame:
    """Parts under the area go, but never the largest of a feature."""
    outer = ring_area(vertices).where("ring = 0").withColumn("largest", F.max("area").over(Window.partitionBy("feature_id")))
    keep = outer.where((F.col("area") >= least_area) | (F.col("area") == F.col("largest"))).select("feature_id", "part")
    return vertices.join(keep, ["feature_id", "part"], "left_semi")


def tiers(lines: DataFrame, size: float = 5.0) -> DataFrame:
    """Lines by tier of two measures and grid cell, counted."""
    tier = F.when((F.col("upland") >= 10000) | (F.col("flow") >= 100), 1).when((F.col("upland") >= 1000) | (F.col("flow") >= 10), 2).otherwise(3)
    cell = lambda c: F.floor(F.col(c) / size) * size
    return lines.groupBy(tier.alias("tier"), cell("lon").alias("cell_lon"), cell("lat").alias("cell_lat")).agg(F.count(F.lit(1)).alias("n"))


def compacted(points: DataFrame, properties: dict[str, Column], precision: int) -> DataFrame:
    """The named properties of each row and its coordinates, rounded."""
    return points.select(*[column.alias(name) for name, column in properties.items()], F.round("lon", precision).alias("lon"), F.round("lat", precision).alias("lat"))


def layer_class(kind: Column, classes: dict[str, str], default: str = "other") -> Column:
    """Class of a feature by its kind."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(default))


def layer(features: DataFrame, classes: dict[str, tuple[str, int]], threshold: float) -> DataFrame:
    """A thematic layer of features (``kind, measure``): those of a listed kind, with ``class`` and least ``zoom``, split into ``main`` and ``detail`` by their measure."""
    rows = features.where(F.col("kind").isin(*classes))
    kind = layer_class(F.col("kind"), {k: c for k, (c, _) in classes.items()})
    zoom = layer_class(F.col("kind"), {k: str(z) for k, (_, z) in classes.items()}).cast("int")
    return rows.withColumns({"class": kind, "zoom": zoom, "part": F.when(F.col("measure") >= threshold, "main").otherwise("detail")})


def places_union(first: DataFrame, second: DataFrame, least_population: int) -> DataFrame:
    """Places of two sources that are large enough, most populous first, then by name."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.where(F.col("population") >= least_population).orderBy(F.desc("population"), "name")


def layer_summary(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows of each layer."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n") for name, rows in layers.items()])


def active_layer(incidents: DataFrame, zones: DataFrame, levels: tuple[str, ...], newest: int = 400) -> DataFrame:
    """Zones of some levels on the path of any of the newest incidents."""
    top = incidents.orderBy(F.desc("last_seen"), "id").limit(newest)
    return top.select(F.explode("zone_path").alias("zone_id")).distinct().join(zones.where(F.col("level").isin(*levels)), "zone_id")
