"""Validation: offender tables and one report row per mesh."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.functions.shared import staged

from .components import components
from .frame import MeshFrame
from .geometry import face_points
from .weld import leaders

#: Faces of smaller area are degenerate.
NO_AREA = 1e-18


def vertex_components(m: MeshFrame) -> DataFrame:
    """mesh_id, v, component (least v of it): vertices joined by edges; isolated ones are components too."""
    at = lambda c: F.struct("mesh_id", F.col(c).alias("v"))
    found = components(m.radial.select(at("lo").alias("a"), at("hi").alias("b"))).select("node.mesh_id", "node.v", F.col("component.v").alias("component"))
    return m.live_vertices.select("mesh_id", "v").join(found, ["mesh_id", "v"], "left").select("mesh_id", "v", F.coalesce("component", "v").alias("component"))


def face_components(m: MeshFrame) -> DataFrame:
    """mesh_id, f, component (least f of it): faces joined by any shared edge."""
    c = m.corners.select("mesh_id", "f", F.least("v", "next_v").alias("lo"), F.greatest("v", "next_v").alias("hi"))
    hub = c.groupBy("mesh_id", "lo", "hi").agg(F.min("f").alias("g"))
    at = lambda x: F.struct("mesh_id", F.col(x).alias("f"))
    found = components(c.join(hub, ["mesh_id", "lo", "hi"]).select(at("f").alias("a"), at("g").alias("b")))
    return found.select("node.mesh_id", "node.f", F.col("component.f").alias("component"))


def boundary_loops(m: MeshFrame) -> DataFrame:
    """mesh_id, loop (least half-edge), n_edges of every boundary loop."""
    h = staged(m.open_halfedges().select("mesh_id", "h", "next_h"), "open-sides")
    at = lambda c: F.struct("mesh_id", F.col(c).alias("h"))
    found = components(h.select(at("h").alias("a"), at("next_h").alias("b")))
    return found.groupBy("node.mesh_id", F.col("component.h").alias("loop")).agg(F.count("*").alias("n_edges")).toDF("mesh_id", "loop", "n_edges")


def nonmanifold_vertices(m: MeshFrame) -> DataFrame:
    """mesh_id, v whose faces don't form one fan."""
    # Not by a join with the good ones: they are many, and by their estimated size Spark would collect them in the driver.
    return m.fans().where("ring is null").select("mesh_id", "v")


def nonmanifold_edges(m: MeshFrame) -> DataFrame:
    """mesh_id, lo, hi, n_faces of edges with three or more sides."""
    return m.radial.where("n_faces > 2").select("mesh_id", "lo", "hi", "n_faces")


def connectivity_errors(m: MeshFrame) -> DataFrame:
    """mesh_id, h of half-edges whose neighbours don't fit: next, previous, opposite, face or ends."""
    h = m.halfedges
    n = h.select("mesh_id", F.col("h").alias("next_h"), F.col("src").alias("ns"), F.col("prev_h").alias("np"), F.col("f").alias("nf"))
    o = h.select("mesh_id", F.col("h").alias("o"), F.col("src").alias("os"), F.col("dst").alias("od"))
    x = h.withColumn("o", F.col("h").bitwiseXOR(1)).join(n, ["mesh_id", "next_h"], "left").join(o, ["mesh_id", "o"], "left")
    good = (F.col("ns") == F.col("dst")) & (F.col("np") == F.col("h")) & F.col("nf").eqNullSafe(F.col("f")) & (F.col("os") == F.col("dst")) & (F.col("od") == F.col("src"))
    return x.where(~F.coalesce(good, F.lit(False))).select("mesh_id", "h")


def incoherent_edges(m: MeshFrame) -> DataFrame:
    """mesh_id, lo, hi of edges that two faces run along in the same direction."""
    return m.radial.where("n_faces = 2 and first.v0 = last.v0").select("mesh_id", "lo", "hi")


def degenerate_faces(m: MeshFrame, min_area: float = NO_AREA) -> DataFrame:
    """mesh_id, f of faces with under 3 vertices, a repeated vertex or no area."""
    flat = face_points(m).where(V.norm(V.newell(F.col("pts"))) / 2 < min_area).select("mesh_id", "f", F.lit(True).alias("flat"))
    rows = m.live_faces.join(flat, ["mesh_id", "f"], "left")
    return rows.where((F.size("verts") < 3) | (F.size(F.array_distinct("verts")) < F.size("verts")) | F.col("flat")).select("mesh_id", "f")


def duplicate_faces(m: MeshFrame) -> DataFrame:
    """mesh_id, first, f: faces of the same vertices as an earlier face."""
    keyed = m.live_faces.select("mesh_id", "f", F.sort_array("verts").alias("key"))
    first = keyed.groupBy("mesh_id", "key").agg(F.min("f").alias("first"))
    return keyed.join(first, ["mesh_id", "key"]).where("f <> first").select("mesh_id", "first", "f")


def duplicate_vertices(m: MeshFrame, tol: float = 1e-10) -> DataFrame:
    """mesh_id, leader, v: vertices within ``tol`` of an earlier leader."""
    return leaders(m, tol).where("v <> leader").select("mesh_id", "leader", "v")


def triangles_cross(p: np.ndarray, q: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Whether pairs of triangles (k, 3, 3) meet, by the overlap of their cuts with the other's plane.

    Coplanar pairs don't count.
    """

    def plane(t):
        n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        return n, -np.einsum("ij,ij->i", n, t[:, 0])

    def heights(n, d, t):
        h = np.einsum("ij,ikj->ik", n, t) + d[:, None]
        h[np.abs(h) < eps] = 0
        return h

    (n1, d1), (n2, d2) = plane(p), plane(q)
    hq, hp = heights(n1, d1, q), heights(n2, d2, p)
    apart = ((hq > 0).all(1) | (hq < 0).all(1)) | ((hp > 0).all(1) | (hp < 0).all(1))
    flat = (hq == 0).all(1) | (hp == 0).all(1)
    axis = np.abs(np.cross(n1, n2)).argmax(1)
    rows = np.arange(len(p))

    def interval(t, h):
        x = t[rows, :, axis]
        lo, hi = np.full(len(t), np.inf), np.full(len(t), -np.inf)
        for i in range(3):
            j = (i + 1) % 3
            on = h[:, i] == 0
            cut = h[:, i] * h[:, j] < 0
            with np.errstate(divide="ignore", invalid="ignore"):
                y = x[:, i] + (x[:, j] - x[:, i]) * h[:, i] / (h[:, i] - h[:, j])
            for at, ok in ((x[:, i], on), (y, cut)):
                lo, hi = np.where(ok, np.minimum(lo, at), lo), np.where(ok, np.maximum(hi, at), hi)
        return lo, hi

    (a, b), (c, d) = interval(p, hp), interval(q, hq)
    return ~apart & ~flat & (np.maximum(a, c) <= np.minimum(b, d) + eps)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, q = (np.array(batch.column(i).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 3, 3) for i in (3, 4))
        hit = triangles_cross(p, q) if len(p) else np.zeros(0, bool)
        yield batch.filter(pa.array(hit)).select([0, 1, 2])


def self_intersections(m: MeshFrame) -> DataFrame:
    """mesh_id, f, g: pairs of triangles that cross without sharing a vertex.

    Boxes meet in the cells of a grid as wide as two mean boxes; a pair counts only in the cell that holds the low
    corner of the boxes' common part.  All triangles take part and all pairs are reported.
    """
    t = face_points(m).where("size(pts) = 3").join(m.live_faces.select("mesh_id", "f", "verts"), ["mesh_id", "f"])
    for c in "xyz":
        t = t.withColumn(f"lo_{c}", F.array_min(F.col(f"pts.{c}"))).withColumn(f"hi_{c}", F.array_max(F.col(f"pts.{c}")))
    t = t.withColumn("flat", F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"], p["z"]))))
    wide = t.groupBy("mesh_id").agg((F.avg(F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"])) * 2 + 1e-9).alias("cell"))
    t = staged(t.join(wide, "mesh_id").drop("pts"), "boxes")
    boxed = t
    for c in "xyz":
        boxed = boxed.withColumn(f"i_{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / F.col("cell")), F.floor(F.col(f"hi_{c}") / F.col("cell")))))
    a, b = boxed.alias("a"), boxed.alias("b")
    on = F.expr("a.mesh_id = b.mesh_id and a.i_x = b.i_x and a.i_y = b.i_y and a.i_z = b.i_z and a.f < b.f")
    near = [F.expr(f"a.lo_{c} <= b.hi_{c} and b.lo_{c} <= a.hi_{c} and a.i_{c} = floor(greatest(a.lo_{c}, b.lo_{c}) / a.cell)") for c in "xyz"]
    pairs = a.join(b, on & near[0] & near[1] & near[2]).where("not arrays_overlap(a.verts, b.verts)")
    pairs = pairs.select("a.mesh_id", "a.f", F.col("b.f").alias("g"), F.col("a.flat").alias("p"), F.col("b.flat").alias("q"))
    return pairs.mapInArrow(_crossing, "mesh_id bigint, f bigint, g bigint")


def report(m: MeshFrame, tol: float = 1e-10, intersections: bool = False) -> DataFrame:
    """One row per mesh: counts, components, loops, euler, genus, numbers of offenders and ok."""

    def tally(rows: DataFrame, name: str) -> DataFrame:
        # Staged, a row a mesh: one plan of all the checks is more than the driver should hold.
        return staged(rows.groupBy("mesh_id").agg(F.count("*").alias(name)), "tally")

    comps = staged(vertex_components(m).groupBy("mesh_id").agg(F.count_distinct("component").alias("n_components")), "tally")
    out = staged(m.counts(), "tally").join(comps, "mesh_id", "left")
    parts = {
        "n_loops": boundary_loops(m), "n_isolated": m.isolated_vertices(), "n_nonmanifold_vertices": nonmanifold_vertices(m), "n_nonmanifold_edges": nonmanifold_edges(m), "n_connectivity_errors": connectivity_errors(m),
        "n_incoherent_edges": incoherent_edges(m), "n_degenerate": degenerate_faces(m), "n_duplicate_vertices": duplicate_vertices(m, tol), "n_duplicate_faces": duplicate_faces(m),
    }
    if intersections:
        parts["n_self_intersections"] = self_intersections(m)
    for name, rows in parts.items():
        out = out.join(tally(rows, name), "mesh_id", "left")
    out = out.na.fill(0)
    bad = [c for c in parts if c not in ("n_loops", "n_isolated", "n_incoherent_edges")]
    genus = F.expr("(2 * n_components - euler - n_loops) div 2")
    return out.withColumn("genus", genus).withColumn("is_closed", F.col("n_boundary_edges") == 0).withColumn("is_oriented", F.col("n_incoherent_edges") == 0).withColumn("ok", sum((F.col(c) for c in bad), F.lit(0)) == 0)


def summary(rows: DataFrame) -> DataFrame:
    """mesh_id, text: a report row in words."""
    text = F.format_string("V %d E %d F %d, %d components, %d loops, Euler %d, genus %d: %s", "n_vertices", "n_edges", "n_faces", "n_components", "n_loops", "euler", "genus", F.when(F.col("ok"), "ok").otherwise("not ok"))
    return rows.select("mesh_id", text.alias("text"))


def is_valid(m: MeshFrame) -> DataFrame:
    """mesh_id, valid: connectivity, manifoldness and no degenerate face."""
    # Staged, as in ``report``: one plan of all the checks is more than the driver should hold.
    offenders = (connectivity_errors, nonmanifold_vertices, nonmanifold_edges, degenerate_faces)
    first, *more = [staged(of(m).select("mesh_id").distinct(), "bad") for of in offenders]
    bad = reduce(DataFrame.union, more, first).distinct().withColumn("bad", F.lit(True))
    return m.live_vertices.select("mesh_id").distinct().join(bad, "mesh_id", "left").select("mesh_id", F.col("bad").isNull().alias("valid"))
