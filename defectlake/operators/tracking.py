"""Damage in space and time: lifting to 3-D, host elements, stationing, campaign matching and tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import clamp
from ..session import broadcast_if_small, checkpoint, stored
from .selection import select_pairs
from .spatial import NearestIndex, cell_range, near_pairs, nearest_within, places

# Lifting and matching limits.
MAX_VERTEX_PX, CLOSED_VERTICES, OPEN_VERTICES = 36.0, 64, 32
MAX_CENTROID_DISTANCE, STABLE_TOLERANCE = 0.5, 0.05
RAY_VERTICES = 16

BLOCK_REACHES = 64  # side of the blocks that are matched side by side, in reaches


def _vertices() -> Column:
    """At most 64 (closed) or 32 (open) evenly spaced vertices of ``points`` as an array."""
    limit = F.when(F.col("closed"), CLOSED_VERTICES).otherwise(OPEN_VERTICES)
    n = F.size("points")
    index = F.when(n <= limit, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
        F.transform(F.sequence(F.lit(0), limit - 1), lambda i: F.least(n - 1, F.floor(i * (n - 1) / (limit - 1) + 0.5).cast("int"))))
    return F.when(n <= limit, F.col("points")).otherwise(F.transform(index, lambda i: F.get("points", i)))


def sampled_vertices(records: DataFrame) -> DataFrame:
    """The vertices of :func:`_vertices` as rows, with their order."""
    rows = records.where(F.size("points") > 0).select("view_id", "record_id", "damage_class", "closed", F.posexplode(_vertices()).alias("seq", "p"))
    return rows.select("view_id", "record_id", "damage_class", "closed", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# Visible places that every task may hold in memory, at some 20 bytes each; beyond, vertices and places meet by shuffles.
HELD_PLACES = 1_000_000
RECORD = ("view_id", "record_id", "damage_class", "closed")


def lift_records(records: DataFrame, visible: DataFrame, scale_x: float, scale_y: float, radius: float = MAX_VERTEX_PX) -> DataFrame:
    """World points behind the outline of each record, with the reprojection error.

    Records: view_id, record_id, damage_class, closed, points. Projected points at equal positions take part in the search
    once. Places that fit into memory go to the records, which then stay where they are; only records that are given
    several times are brought together.
    """
    spots = visible.where("visible").groupBy("view_id", (F.col("u") * scale_x).alias("x"), (F.col("v") * scale_y).alias("y")).agg(F.min("point_id").alias("point_id"))
    spots = stored(places(spots, ["x", "y"]).where("view_id IS NOT NULL"))
    if spots.count() > HELD_PLACES:
        return _lift_by_place(records, spots, radius)
    held = spots.orderBy("point_id").toArrow()
    ids = held["point_id"].combine_chunks()
    seen = held["view_id"].combine_chunks().dictionary_encode()
    # Equal ids are one point, wherever it is seen.
    rank = np.concatenate([[0], np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))]) if len(ids) > 1 else np.zeros(len(ids), np.int64)
    where = np.column_stack([held["x"].to_numpy(), held["y"].to_numpy()])
    sc = records.sparkSession.sparkContext
    shared, names = sc.broadcast((seen.dictionary, seen.indices.to_numpy(), where, rank)), sc.broadcast(ids.take(pa.array(np.unique(rank, return_index=True)[1])))

    who = list(RECORD)
    same = F.xxhash64(*who).alias("_same")
    records = records.where(F.size("points") > 0)
    again = broadcast_if_small(checkpoint(records.groupBy(same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_same")))
    rows = records.select(*who, _vertices().alias("_v"), same)
    once = _lifted(rows.join(again, "_same", "left_anti"), shared, radius).select(*who, "matches", "squares", "point")
    many = _lifted(rows.join(again, "_same", "left_semi"), shared, radius).select(*who, F.explode(F.arrays_zip("seq", "point", "d")).alias("m")).select(*who, "m.*")
    many = many.repartition("view_id", "record_id").groupBy(*who, "point").agg(F.min("seq").alias("seq"), F.min_by("d", "seq").alias("d"))
    many = many.groupBy(*who).agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("d") * F.col("d")).alias("squares"),
                                  F.transform(F.array_sort(F.collect_list(F.struct("seq", "point"))), lambda s: s["point"]).alias("point"))

    @F.arrow_udf(T.ArrayType(spots.schema["point_id"].dataType))
    def named(lists: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()), names.value.take(lists.values))

    return once.unionByName(many).where("matches >= 2").select(
        *who, "matches", F.sqrt(F.col("squares") / F.col("matches")).alias("reprojection_rmse"), named("point").alias("point_ids"))


def _lifted(rows: DataFrame, shared: Broadcast, radius: float) -> DataFrame:
    """Records with the points that their vertices ``_v`` find, each by its first vertex, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, group, where, rank = shared.value
        index = NearestIndex(group, where, radius)
        for batch in batches:
            v = batch["_v"]
            sizes, flat = pc.list_value_length(v).to_numpy(), v.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            seq = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            view = pc.index_in(batch["view_id"].cast(views.type), value_set=views).fill_null(-1).to_numpy()
            spot = np.column_stack([pc.struct_field(flat, a).fill_null(np.nan).to_numpy() for a in "xy"])
            found, d, _ = index.query(view[row], spot)
            hit = np.flatnonzero((found >= 0) & (d < radius))
            point = rank[found[hit]]
            hit = np.sort(hit[np.unique(row[hit] * (len(rank) + 1) + point, return_index=True)[1]])  # the first vertex at a point
            counts = np.bincount(row[hit], minlength=len(sizes))
            squares = np.bincount(row[hit], d[hit] * d[hit], minlength=len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            listed = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (seq[hit].astype(np.int32), rank[found[hit]].astype(np.int32), d[hit])]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in who], pa.array(counts.astype(np.int64)), pa.array(squares.astype(float)), *listed], names=[f.name for f in schema])

    who = list(RECORD)
    schema = T.StructType([*rows.select(*who).schema.fields, T.StructField("matches", T.LongType()), T.StructField("squares", T.DoubleType()),
                           *[T.StructField(c, T.ArrayType(t)) for c, t in (("seq", T.IntegerType()), ("point", T.IntegerType()), ("d", T.DoubleType()))]])
    return rows.select(*who, "_v").mapInArrow(run, schema)


def _lift_by_place(records: DataFrame, spots: DataFrame, radius: float) -> DataFrame:
    """Records by a join of the distinct places of their vertices with the spots found there."""
    verts = sampled_vertices(records)
    hit = nearest_within(verts, spots, ["view_id"], ["x", "y"], "point_id", radius, radius / 9).where(F.col("distance") < radius)
    # Matches are brought together by record once; both groupings below keep to that, and nothing is sorted before.
    matched = verts.join(hit.hint("merge"), ["view_id", "x", "y"]).repartition("view_id", "record_id")
    matched = matched.groupBy("view_id", "record_id", "damage_class", "closed", "point_id").agg(
        F.min("seq").alias("seq"), F.min_by("distance", "seq").alias("d"))  # plain values: a struct could not be hashed in place and would be sorted
    out = matched.groupBy("view_id", "record_id", "damage_class", "closed").agg(
        F.count(F.lit(1)).alias("matches"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("reprojection_rmse"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "point_id"))), lambda s: s["point_id"]).alias("point_ids"))
    return out.where("matches >= 2")


def record_centroid(vertices: DataFrame, key: str) -> DataFrame:
    """Mean of the finite vertices of each record."""
    ok = None
    for a in "xyz":
        fine = F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
        ok = fine if ok is None else ok & fine
    return vertices.where(ok).groupBy(key).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("vertices"))


def _dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _sub(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [a - b for a, b in zip(u, v)]


def point_triangle_distance(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Distance from a point to a triangle: to its plane above the face, otherwise to the nearest edge.

    Edge vectors and offset are taken once, as fields of a one-element array, which keeps the generated code small.
    """
    vectors = {"u": _sub(b, a), "v": _sub(c, a), "w": _sub(p, a)}
    packed = F.array(F.struct(*[vec[i].alias(f"{name}{i}") for name, vec in vectors.items() for i in range(3)]))

    def edge(d: Sequence[Column], w: Sequence[Column]) -> Column:
        t = clamp(F.coalesce(_dot(w, d) / F.nullif(_dot(d, d), F.lit(0.0)), F.lit(0.0)), 0, 1)
        e = [w[i] - t * d[i] for i in range(3)]
        return F.sqrt(_dot(e, e))

    def distance(q: Column) -> Column:
        u, v, w = ([q[f"{name}{i}"] for i in range(3)] for name in "uvw")
        uu, uv, vv, wu, wv = _dot(u, u), _dot(u, v), _dot(v, v), _dot(w, u), _dot(w, v)
        den = F.nullif(uu * vv - uv * uv, F.lit(0.0))
        s, t = (wu * vv - wv * uv) / den, (wv * uu - wu * uv) / den
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        plane = F.abs(_dot(w, n)) / F.sqrt(F.nullif(_dot(n, n), F.lit(0.0)))
        inside = F.coalesce((s >= 0) & (t >= 0) & (s + t <= 1), F.lit(False))
        return F.when(inside, plane).otherwise(F.least(edge(u, w), edge(v, w), edge(_sub(v, u), _sub(w, u))))

    return F.element_at(F.transform(packed, distance), 1)


TRI = [("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")]


def _near_triangles(points: DataFrame, triangles: DataFrame, reach: float, cell: float) -> DataFrame:
    """Point-triangle candidates through the grid cells of each triangle's box grown by ``reach``."""
    grid = triangles
    for i, a in enumerate("xyz"):
        low = F.least(*[F.col(t[i]) for t in TRI]) - reach
        high = F.greatest(*[F.col(t[i]) for t in TRI]) + reach
        grid = grid.withColumn(f"_lo{a}", low).withColumn(f"_hi{a}", high).withColumn(f"_c{a}", F.explode(cell_range(low, high, cell)))
    rows = points.select("*", *[F.floor(F.col(a) / cell).cast("long").alias(f"_c{a}") for a in "xyz"])
    joined = rows.join(grid, ["_cx", "_cy", "_cz"])
    for a in "xyz":
        joined = joined.where(F.col(a).between(F.col(f"_lo{a}"), F.col(f"_hi{a}")))
    return joined


def nearest_element(records: DataFrame, triangles: DataFrame, max_distance: float = 0.5, cell: float = 2.0) -> DataFrame:
    """Host element by closest surface distance with the outcome per record.

    Records: record_id, host_id (may be null), x, y, z (null without geometry). Positions that occur several times are
    resolved once.
    """
    open_rows = records.where(F.col("host_id").isNull() & F.col("x").isNotNull())
    spots = open_rows.select("x", "y", "z").distinct()
    d = point_triangle_distance([F.col(a) for a in "xyz"], *[[F.col(k) for k in t] for t in TRI])
    near = _near_triangles(spots, triangles, max_distance, cell).withColumn("distance", d).where(F.col("distance") <= max_distance)
    best = near.groupBy("x", "y", "z").agg(F.min(F.struct("distance", "element_id", "global_id")).alias("b"))
    out = records.join(best, ["x", "y", "z"], "left")
    status = (F.when(F.col("host_id").isNotNull(), "already_had_host").when(F.col("x").isNull(), "no_3d_geometry")
              .when(F.col("b").isNotNull(), "resolved").otherwise("no_match_within_threshold"))
    fresh = F.col("host_id").isNull()
    return out.select("record_id", status.alias("status"), F.when(fresh, F.col("b.global_id")).alias("host_global_id"), F.when(fresh, F.col("b.distance")).alias("host_distance"))


def axis_ray_bind(vertices: DataFrame, triangles: DataFrame, max_distance: float, frame_ok: bool = True, cell: float = 2.0) -> DataFrame:
    """First surface along the six axis directions from the first 16 vertices of each record.

    Vertices: record_id, seq, x, y, z. Without a verified spatial frame nothing is bound.
    """
    records = vertices.select("record_id").distinct()
    if not frame_ok:
        return records.select("record_id", F.lit("frame_unverified").alias("status"), F.lit(None).cast("string").alias("global_id"), F.lit(None).cast("double").alias("distance"))
    rows = vertices.where(F.col("seq") < RAY_VERTICES).select("record_id", "x", "y", "z")
    spots = rows.select("x", "y", "z").distinct()
    hits = []
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        a, b, c = [[F.col(t[n]) for n in (i, j, k)] for t in TRI]
        p = [F.col("xyz"[n]) for n in (i, j, k)]
        den = F.nullif((b[1] - a[1]) * (c[2] - a[2]) - (c[1] - a[1]) * (b[2] - a[2]), F.lit(0.0))
        s = ((p[1] - a[1]) * (c[2] - a[2]) - (c[1] - a[1]) * (p[2] - a[2])) / den
        t = ((b[1] - a[1]) * (p[2] - a[2]) - (p[1] - a[1]) * (b[2] - a[2])) / den
        hits.append(F.when((s >= 0) & (t >= 0) & (s + t <= 1), F.abs(a[0] + s * (b[0] - a[0]) + t * (c[0] - a[0]) - p[0])))
    near = _near_triangles(spots, triangles, max_distance, cell).withColumn("distance", F.least(*hits)).where(F.col("distance") <= max_distance)
    best = near.groupBy("x", "y", "z").agg(F.min(F.struct("distance", "global_id")).alias("b"))
    bound = rows.join(best, ["x", "y", "z"]).groupBy("record_id").agg(F.min("b").alias("b"))
    return records.join(bound, "record_id", "left").select("record_id", F.when(F.col("b").isNotNull(), "bound").otherwise("unbound").alias("status"),
                                                           F.col("b.global_id").alias("global_id"), F.col("b.distance").alias("distance"))


def alignment_segments(alignment: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Segments of an ordered polyline (seq, x, y, z) with start chainage and total length."""
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("seq")
    rows = alignment.select(*keys, "seq", *[F.col(a).alias(f"s{a}") for a in "xyz"], *[F.lead(a).over(order).alias(f"e{a}") for a in "xyz"]).where(F.col("ex").isNotNull())
    rows = rows.withColumn("length", F.sqrt(sum((F.col(f"e{a}") - F.col(f"s{a}")) * (F.col(f"e{a}") - F.col(f"s{a}")) for a in "xyz")))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return rows.withColumn("walked", F.coalesce(F.sum("length").over(upto), F.lit(0.0))).withColumn("total", total).withColumn("last", F.lead("seq").over(order).isNull())


REACH_FACTOR = 4.0


def station_on_alignment(points: DataFrame, segments: DataFrame, point_id: str) -> DataFrame:
    """Chainage, ratio and lateral offset of points on a polyline; the first segment wins ties.

    Segments enter the plan cells around them that lie within a reach, points the cell they lie in. A round settles the
    points whose nearest segment is within the reach; the others go on with a longer one, so neither the number of
    segments nor the distance of a point is limited. Points with a missing or infinite coordinate have no station.
    """
    parts = checkpoint(segments.where("length > 0"))
    longest = parts.agg(F.max("length")).first()[0]
    finite = F.greatest(*[F.abs(F.col(a)) for a in "xyz"]) < F.lit(float("inf"))
    rest = points.select(point_id, "x", "y", "z").where(finite & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    empty = rest.limit(0).select(point_id, F.lit(0.0).alias("station"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("offset"))
    if longest is None:
        return empty
    rest, reach, found = checkpoint(rest), float(longest), []
    a, d, p = [F.col(f"s{k}") for k in "xyz"], [F.col(f"e{k}") - F.col(f"s{k}") for k in "xyz"], [F.col(k) for k in "xyz"]
    while not rest.isEmpty():
        near = parts
        for k in "xy":
            low, high = F.least(f"s{k}", f"e{k}") - reach, F.greatest(f"s{k}", f"e{k}") + reach
            near = near.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(low / reach).cast("long"), F.floor(high / reach).cast("long"))))
        pairs = rest.withColumn("_cx", F.floor(F.col("x") / reach).cast("long")).withColumn("_cy", F.floor(F.col("y") / reach).cast("long")).join(near, ["_cx", "_cy"])
        pairs = pairs.withColumn("_t", clamp(_dot(_sub(p, a), d) / (F.col("length") * F.col("length")), 0, 1))
        e = [p[i] - (a[i] + F.col("_t") * d[i]) for i in range(3)]
        one = F.struct(F.sqrt(_dot(e, e)).alias("offset"), "seq", (F.col("walked") + F.col("length") * F.col("_t")).alias("along"), "total")
        best = checkpoint(pairs.withColumn("_b", one).where(F.col("_b.offset") <= reach).groupBy(point_id).agg(F.min("_b").alias("b")))
        found.append(best)
        rest = checkpoint(rest.join(best.select(point_id), point_id, "left_anti"))
        reach *= REACH_FACTOR
    if not found:
        return empty
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select(point_id, F.col("b.along").alias("station"), (F.col("b.along") / F.nullif("b.total", F.lit(0.0))).alias("ratio"), F.col("b.offset").alias("offset"))


def point_at_station(stations: DataFrame, segments: DataFrame, station_id: str) -> DataFrame:
    """Point and unit tangent at a ratio of the alignment length (``stations``: id, ratio).

    Stations and segments meet in stretches of the mean segment length; a segment is entered one stretch beyond both of
    its ends, which covers rounding of the chainage.
    """
    parts = checkpoint(segments)
    size = parts.agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, stretch = size["total"] or 0.0, max((size["total"] or 0.0) / max(size["n"], 1), 1e-300)
    placed = parts.withColumn("_k", F.explode(F.sequence(F.floor(F.col("walked") / stretch).cast("long") - 1, F.floor((F.col("walked") + F.col("length")) / stretch).cast("long") + 1)))
    rows = stations.select(station_id, "ratio").withColumn("_t", F.lit(total) * clamp(F.col("ratio"), 0, 1)).withColumn("_k", F.floor(F.col("_t") / stretch).cast("long"))
    rows = rows.join(placed, "_k").where((F.col("walked") + F.col("length") >= F.col("_t")) | F.col("last"))
    rows = rows.groupBy(station_id, "_t").agg(F.min(F.struct("seq", F.struct(*segments.columns).alias("s"))).alias("_b"))
    s = F.col("_b.s")
    t = F.coalesce(clamp((F.col("_t") - s["walked"]) / F.nullif(s["length"], F.lit(0.0)), 0, 1), F.lit(0.0))
    return rows.select(station_id, F.col("_t").alias("distance"), *[(s[f"s{a}"] + t * (s[f"e{a}"] - s[f"s{a}"])).alias(a) for a in "xyz"],
                       *[((s[f"e{a}"] - s[f"s{a}"]) / F.nullif(s["length"], F.lit(0.0))).alias(f"tangent_{a}") for a in "xyz"])


def to_brim_dataset(records: DataFrame) -> DataFrame:
    """Export shape of a damage record: the host appears only when the record is bound."""
    bound = F.col("status") == "bound"
    return records.select("record_id", F.lit("CDM3-BrIM-Damage/1.1").alias("schema"), "damage_class", F.when(bound, F.struct("global_id")).alias("host"),
                          F.struct(F.coalesce("status", F.lit("not_evaluated")).alias("status"), F.lit("six_axis_surface_raycast").alias("method"), F.col("distance")).alias("association"))


def brim_counts(dataset: DataFrame, keys: Sequence[str] = ("damage_class",)) -> DataFrame:
    bound = F.col("association.status") == "bound"
    return dataset.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(bound).alias("bound"), F.count_if(~bound).alias("unbound"))


# Cells of the pairing, in distances: a record is copied into some 1.5 cells an axis instead of 3.
PAIR_CELL = 4.0


def candidate_pairs(previous: DataFrame, current: DataFrame, keys: Sequence[str], max_distance: float = MAX_CENTROID_DISTANCE) -> DataFrame:
    """Same class, compatible host and centroids within the distance (columns ``l_`` = current, ``r_`` = previous)."""
    pairs = near_pairs(current.where(F.col("x").isNotNull()), previous.where(F.col("x").isNotNull()), [*keys, "damage_class"], ["x", "y", "z"], max_distance, cell=PAIR_CELL * max_distance)
    return pairs.where(F.col("l_host_id").isNull() | F.col("r_host_id").isNull() | (F.col("l_host_id") == F.col("r_host_id")))


METRIC_PARTS = ("metric_kind", "metric_unit", "metric_comparable")


def _metric(side: str, rows: DataFrame) -> Column:
    """Value and kind of a record's metric, null unless it is positive, comparable and has a kind and a unit.

    Records without these columns have one kind of metric, which counts.
    """
    have = {c: F.col(side + c) if c in rows.columns else None for c in METRIC_PARTS}
    text = lambda c: F.lit("one") if have[c] is None else F.nullif(F.trim(have[c].cast("string")), F.lit(""))
    valid = F.lit(True) if have["metric_comparable"] is None else F.coalesce(have["metric_comparable"], F.lit(False))
    value = F.col(side + "metric_value")
    return F.when((value > 0) & valid & text("metric_unit").isNotNull() & text("metric_kind").isNotNull(), F.struct(value.alias("value"), text("metric_kind").alias("kind")))


def match_campaigns(previous: DataFrame, current: DataFrame, keys: Sequence[str], max_distance: float = MAX_CENTROID_DISTANCE, tolerance: float = STABLE_TOLERANCE) -> DataFrame:
    """Greedy one-to-one match of current records to the nearest unused previous record and the change of their metric.

    Records of a class and key are dealt to blocks by their place, which are settled side by side, see :mod:`.selection`.
    """
    keys = list(keys)
    pairs = candidate_pairs(previous, current, keys, max_distance).select(
        *[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_damage_class").alias("damage_class"), F.col("l_record_id").alias("record_id"), F.col("r_record_id").alias("previous_id"),
        _metric("l_", current).alias("metric"), _metric("r_", previous).alias("previous_metric"), "distance",
        F.col("l_x").alias("_x"), F.col("l_y").alias("_y"))
    group = [*keys, "damage_class"]
    tile = BLOCK_REACHES * max_distance
    block = F.struct(F.floor(F.col("_x") / tile).alias("x"), F.floor(F.col("_y") / tile).alias("y")).cast("string")
    chosen = select_pairs(pairs, group, "record_id", "previous_id", [F.col("record_id"), F.col("distance"), F.col("previous_id")], block)
    best = chosen.select(*keys, "record_id", "previous_id", "metric", "previous_metric", "distance")
    out = current.select(*keys, "record_id", "damage_class", "x").join(best, [*keys, "record_id"], "left")
    ratio = (F.col("metric.value") - F.col("previous_metric.value")) / F.nullif(F.col("previous_metric.value"), F.lit(0.0))
    comparable = F.col("metric.kind") == F.col("previous_metric.kind")
    status = (F.when(F.col("x").isNull(), "not_comparable").when(F.col("previous_id").isNull(), "unmatched").when(~F.coalesce(comparable, F.lit(False)), "matched_not_quantified")
              .when(F.abs(ratio) <= tolerance, "stable").when(ratio > 0, "grown").otherwise("reduced"))
    return out.select(*keys, "record_id", "damage_class", "previous_id", status.alias("change_status"), F.when(comparable, ratio).alias("change_ratio"), "distance")


def damage_timeline(records: DataFrame, max_distance: float = MAX_CENTROID_DISTANCE) -> DataFrame:
    """Match every campaign with the one before it, all pairs at once, and give matched records the track of their root.

    Campaigns go by ``observed_at``, where records have it, those without a date last, then by campaign_id. Roots are found by pointer doubling, so a chain over n campaigns needs log2(n) joins.
    """
    seen = F.min(F.nullif(F.trim(F.col("observed_at").cast("string")), F.lit(""))) if "observed_at" in records.columns else F.lit(None).cast("string")
    campaigns = checkpoint(records.groupBy("campaign_id").agg(seen.alias("observed_at")))  # one row for each campaign
    order = Window.orderBy(F.col("observed_at").asc_nulls_last(), "campaign_id")
    pairs = campaigns.select("campaign_id", F.lag("campaign_id").over(order).alias("previous_campaign"))
    dates = campaigns.select("campaign_id", "observed_at")
    rows = records.drop("observed_at").join(dates, "campaign_id").join(F.broadcast(pairs) if campaigns.count() <= 100_000 else pairs, "campaign_id")
    current = rows.where(F.col("previous_campaign").isNotNull()).withColumn("pair", F.col("campaign_id"))
    nxt = pairs.select(F.col("previous_campaign").alias("campaign_id"), F.col("campaign_id").alias("pair")).where(F.col("campaign_id").isNotNull())
    previous = records.join(nxt, "campaign_id")
    matched = checkpoint(match_campaigns(previous, current, ["pair"], max_distance))
    links = matched.where(F.col("previous_id").isNotNull()).select("record_id", F.col("previous_id").alias("root"))
    while True:
        up = links.select(F.col("record_id").alias("root"), F.col("root").alias("up"))
        links = checkpoint(links.join(up, "root", "left").select("record_id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    first = rows.where(F.col("previous_campaign").isNull()).select("campaign_id", "record_id", "damage_class", F.lit(None).cast("long").alias("previous_id"), F.lit("baseline").alias("change_status"),
                                                                   F.concat(F.lit("cdm3-track-"), F.col("record_id").cast("string")).alias("track_id"))
    later = matched.join(links.drop("moved"), "record_id", "left").select(F.col("pair").alias("campaign_id"), "record_id", "damage_class", "previous_id", "change_status",
                                                                          F.when(F.col("root").isNotNull(), F.concat(F.lit("cdm3-track-"), F.col("root").cast("string"))).alias("track_id"))
    return first.unionByName(later).join(dates, "campaign_id")


def damage_tracks(timeline: DataFrame) -> DataFrame:
    """Observations per track by date, those without one last; a track holds at most one record per campaign."""
    seen = F.array_sort(F.collect_list(F.struct(F.col("observed_at").isNull().alias("undated"), "observed_at", "campaign_id", "record_id", "change_status")))
    return timeline.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(seen.alias("observations"), F.count(F.lit(1)).alias("observation_count"))
