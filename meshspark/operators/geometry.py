"""Measures of faces, edges, vertices, corners and whole meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.functions import vec as V

from .frame import MeshFrame


def points(m: MeshFrame, key: str, name: str) -> DataFrame:
    """(mesh_id, key, name): positions as vectors, to join on."""
    return m.live_vertices.select("mesh_id", F.col("v").alias(key), V.point().alias(name))


def face_points(m: MeshFrame) -> DataFrame:
    """mesh_id, f, pts: the positions of a face's vertices in order."""
    # Corners are estimated by the compressed faces, which may pass for small; unless merged, the driver would collect them.
    c = m.corners.select("mesh_id", "f", "slot", "v").join(points(m, "v", "p").hint("merge"), ["mesh_id", "v"])
    return c.groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "p"))), lambda t: t["p"]).alias("pts"))


def face_measures(m: MeshFrame) -> DataFrame:
    """mesh_id, f, normal, area, centroid of every face."""
    got = face_points(m).withColumn("n2", V.newell(F.col("pts")))
    total = F.aggregate("pts", V.vec(0.0, 0.0, 0.0), V.add)
    return got.select("mesh_id", "f", V.normalized(F.col("n2")).alias("normal"), (V.norm(F.col("n2")) / 2).alias("area"), V.scale(total, 1 / F.size("pts")).alias("centroid"))


def edge_measures(m: MeshFrame) -> DataFrame:
    """mesh_id, e, vector (from v0 to v1), length, midpoint of every edge."""
    e = m.edges.join(points(m, "v0", "a"), ["mesh_id", "v0"]).join(points(m, "v1", "b"), ["mesh_id", "v1"])
    a, b = F.col("a"), F.col("b")
    return e.select("mesh_id", "e", V.sub(b, a).alias("vector"), V.norm(V.sub(b, a)).alias("length"), V.scale(V.add(a, b), 0.5).alias("midpoint"))


def vertex_normals(m: MeshFrame) -> DataFrame:
    """mesh_id, v, normal: the unweighted sum of the unit normals of a vertex's faces, made a unit."""
    n = face_measures(m).select("mesh_id", "f", "normal")
    s = m.corners.select("mesh_id", "f", "v").join(n, ["mesh_id", "f"]).groupBy("mesh_id", "v").agg(*[F.sum(f"normal.{c}").alias(c) for c in "xyz"])
    s = m.live_vertices.select("mesh_id", "v").join(s, ["mesh_id", "v"], "left").na.fill(0.0)
    return s.select("mesh_id", "v", V.normalized(V.point()).alias("normal"))


def dihedral_angles(m: MeshFrame) -> DataFrame:
    """mesh_id, e, angle: the signed angle between an edge's face normals; 0 on the boundary."""
    n = face_measures(m).select("mesh_id", "f", "normal")
    # The side v0 -> v1 lies in one face, the opposite side in the other.
    c = m.corners.select("mesh_id", "f", "v", "next_v")
    g0 = c.join(n, ["mesh_id", "f"]).select("mesh_id", F.col("v").alias("v0"), F.col("next_v").alias("v1"), F.col("normal").alias("n0"))
    g1 = c.join(n, ["mesh_id", "f"]).select("mesh_id", F.col("v").alias("v1"), F.col("next_v").alias("v0"), F.col("normal").alias("n1"))
    e = m.edges.select("mesh_id", "e", "v0", "v1").join(g0, ["mesh_id", "v0", "v1"], "left").join(g1, ["mesh_id", "v0", "v1"], "left")
    e = e.join(points(m, "v0", "a"), ["mesh_id", "v0"]).join(points(m, "v1", "b"), ["mesh_id", "v1"])
    turn = V.dot(V.cross(F.col("n0"), F.col("n1")), V.sub(F.col("b"), F.col("a")))
    a = V.angle(F.col("n0"), F.col("n1"))
    return e.select("mesh_id", "e", F.coalesce(F.when(turn < 0, -a).otherwise(a), F.lit(0.0)).alias("angle"))


def sector_angles(m: MeshFrame) -> DataFrame:
    """mesh_id, f, slot, angle: the face's angle at the vertex where its side starts."""
    c = m.corners.join(points(m, "v", "p"), ["mesh_id", "v"]).join(points(m, "next_v", "q"), ["mesh_id", "next_v"]).join(points(m, "prev_v", "o"), ["mesh_id", "prev_v"])
    a, b = V.normalized(V.sub(F.col("q"), F.col("p"))), V.normalized(V.sub(F.col("o"), F.col("p")))
    return c.select("mesh_id", "f", "slot", V.angle(a, b).alias("angle"))


def mesh_measures(m: MeshFrame) -> DataFrame:
    """mesh_id, surface_area, center (mean of vertices), low and high corner of the bounding box."""
    area = face_measures(m).groupBy("mesh_id").agg(F.sum("area").alias("surface_area"))
    v = m.live_vertices.groupBy("mesh_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("c", F.avg), ("lo", F.min), ("hi", F.max)) for c in "xyz"])
    v = v.join(area, "mesh_id", "left")
    return v.select("mesh_id", F.coalesce("surface_area", F.lit(0.0)).alias("surface_area"), V.point("c_").alias("center"), V.point("lo_").alias("low"), V.point("hi_").alias("high"))
