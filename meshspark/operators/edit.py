"""Topological editing of sets of elements.

An edit names many edges, faces or half-edges at once; those that would touch the same face are refused, so the
edits of one call don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.functions.numbering import numbered

from .frame import MeshFrame
from .geometry import points


def triangulated(m: MeshFrame) -> MeshFrame:
    """Polygons as fans from their first vertex; ids follow the old faces' order."""
    parts = F.transform(F.sequence(F.lit(1), F.size("verts") - 2), lambda k: F.array(F.get("verts", F.lit(0)), F.get("verts", k), F.get("verts", k + 1)))
    t = m.live_faces.where("size(verts) >= 3").select("mesh_id", F.col("f").alias("old"), F.posexplode(parts).alias("k", "verts"))
    return MeshFrame(m.live_vertices, numbered(t, "f", F.col("old"), F.col("k")).select("mesh_id", "f", "verts"))


def _wings(m: MeshFrame) -> DataFrame:
    """mesh_id, e, v0, v1, f0, f1, c, d: edges between two triangles with their apexes."""
    side = m.corners.where("n = 3").select("mesh_id", "v", "next_v", "f", "after_v")
    e = m.edges.where("n_faces = 2").select("mesh_id", "e", "lo", "hi", "v0", "v1")
    e = e.join(side.toDF("mesh_id", "v0", "v1", "f0", "c"), ["mesh_id", "v0", "v1"])
    return e.join(side.toDF("mesh_id", "v1", "v0", "f1", "d"), ["mesh_id", "v0", "v1"])


def flip_candidates(m: MeshFrame) -> DataFrame:
    """mesh_id, e, ok: whether an interior edge can turn: its tips differ and share no edge; other edges can't."""
    w = _wings(m)
    tips = m.radial.select("mesh_id", F.col("lo").alias("x"), F.col("hi").alias("y"), F.lit(True).alias("near"))
    w = w.withColumns({"x": F.least("c", "d"), "y": F.greatest("c", "d")}).join(tips, ["mesh_id", "x", "y"], "left")
    ok = w.select("mesh_id", "e", ((F.col("c") != F.col("d")) & F.col("near").isNull()).alias("ok"))
    return m.edges.select("mesh_id", "e").join(ok, ["mesh_id", "e"], "left").na.fill(False)


def _independent(rows: DataFrame, faces: Column) -> DataFrame:
    """Raises where two of ``rows`` touch the same face."""
    touched = rows.select("mesh_id", F.explode(faces).alias("f")).where("f is not null").groupBy("mesh_id", "f").agg(F.count("*").alias("n"))
    if not touched.where("n > 1").isEmpty():
        raise ValueError("two of the edits touch the same face")
    return rows


def _replaced(m: MeshFrame, new: DataFrame) -> MeshFrame:
    """Faces of ``new`` (mesh_id, f, parts: array of lists) replaced: the first part keeps f, others follow the last."""
    parts = new.select("mesh_id", "f", F.posexplode("parts").alias("k", "verts"))
    kept = m.live_faces.join(parts.where("k = 0").select("mesh_id", "f", F.col("verts").alias("__v")), ["mesh_id", "f"], "left")
    base = kept.withColumn("verts", F.coalesce("__v", "verts")).select(m.faces.columns)
    more = numbered(parts.where("k > 0").withColumnRenamed("k", "part"), "k", F.col("f"), F.col("part")).select("mesh_id", "k", "verts")
    return MeshFrame(m.live_vertices, base).add_faces(more)


def flip_edges(m: MeshFrame, edges: DataFrame) -> MeshFrame:
    """Edges of ``edges`` (mesh_id, e) turned; raises if one can't or two share a face."""
    chosen = edges.select("mesh_id", "e").distinct()
    if not chosen.join(flip_candidates(m).where("ok"), ["mesh_id", "e"], "left_anti").isEmpty():
        raise ValueError("an edge can't be flipped")
    w = _independent(_wings(m).join(chosen, ["mesh_id", "e"]), F.array("f0", "f1"))
    new = F.array(F.struct(F.col("f0").alias("f"), F.array(F.array("c", "v0", "d")).alias("parts")), F.struct(F.col("f1").alias("f"), F.array(F.array("d", "v1", "c")).alias("parts")))
    return _replaced(m, w.select("mesh_id", F.inline(new)))


def split_edges(m: MeshFrame, edges: DataFrame) -> MeshFrame:
    """Edges of ``edges`` (mesh_id, e) halved at their middle, their triangles with them; with a column v, at that
    vertex of the mesh, whose position stays."""
    e = m.edges.join(edges.select([c for c in ("mesh_id", "e", "v") if c in edges.columns]).distinct(), ["mesh_id", "e"])
    _independent(e, F.array("f0", "f1"))
    if "v" in edges.columns:
        grown, ids = m, e.select("mesh_id", "lo", "hi", F.col("v").alias("w"))
    else:
        mid = e.join(points(m, "v0", "a"), ["mesh_id", "v0"]).join(points(m, "v1", "b"), ["mesh_id", "v1"]).withColumn("p", V.scale(V.add(F.col("a"), F.col("b")), 0.5))
        grown = m.add_vertices(mid.select("mesh_id", F.col("e").alias("k"), *[F.col(f"p.{c}").alias(c) for c in "xyz"]))
        ids = numbered(e.select("mesh_id", "e", "lo", "hi"), "w", F.col("e")).join(_first_free(m), "mesh_id").withColumn("w", F.col("w") + F.col("__v"))
    c = m.corners.where("n = 3").withColumns({"lo": F.least("v", "next_v"), "hi": F.greatest("v", "next_v")}).join(ids, ["mesh_id", "lo", "hi"])
    new = c.select("mesh_id", "f", F.array(F.array("v", "w", "after_v"), F.array("w", "next_v", "after_v")).alias("parts"))
    return _replaced(MeshFrame(grown.vertices, m.faces), new)


def _first_free(m: MeshFrame) -> DataFrame:
    return m.vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("__v"))


def split_faces(m: MeshFrame, faces: DataFrame) -> MeshFrame:
    """Faces of ``faces`` (mesh_id, f) as fans around a new vertex at their centre; with a column v, around that
    vertex of the mesh, whose position stays."""
    from .subdivide import _face_centres

    f = m.live_faces.join(faces.select([c for c in ("mesh_id", "f", "v") if c in faces.columns]).distinct(), ["mesh_id", "f"])
    if "v" in faces.columns:
        grown, ids = m, f.withColumnRenamed("v", "w")
    else:
        f = f.join(_face_centres(m), ["mesh_id", "f"])
        grown = m.add_vertices(f.select("mesh_id", F.col("f").alias("k"), *[F.col(f"centre.{c}").alias(c) for c in "xyz"]))
        ids = numbered(f, "w", F.col("f")).join(_first_free(m), "mesh_id").withColumn("w", F.col("w") + F.col("__v"))
    parts = F.transform("verts", lambda v, i: F.array(v, F.get("verts", (i + 1) % F.size("verts")), F.col("w")))
    return _replaced(MeshFrame(grown.vertices, m.faces), ids.select("mesh_id", "f", parts.alias("parts")))


def collapse_edges(m: MeshFrame, ends: DataFrame | None = None) -> DataFrame:
    """mesh_id, lo, hi, ok: whether one end of an edge can move into the other and the mesh stays manifold; with
    ``ends`` (mesh_id, v, ...) also its columns for both ends, as structs a and b.

    The apexes of the edge must be the only common neighbours and must differ, an apex's two outer edges must not
    both be boundary, and an interior edge must not join two boundary vertices.  An edge with three or more sides, or
    two of one direction, is not ok.
    """
    side = F.struct("f", "slot", "v", F.col("prev_v").alias("apex"), "n")
    e = m.corners.where("v <> next_v").groupBy("mesh_id", F.least("v", "next_v").alias("lo"), F.greatest("v", "next_v").alias("hi")).agg(F.count("*").alias("k"), F.min(side).alias("l"), F.max(side).alias("r"))
    both = F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("w")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("w")))
    star = e.select("mesh_id", "k", F.inline(both)).groupBy("mesh_id", "v").agg(F.collect_list("w").alias("ring"), F.collect_list(F.when(F.col("k") < 2, F.col("w"))).alias("rim"))
    carried = [c for c in ends.columns if c not in ("mesh_id", "v")] if ends is not None else []
    if carried:
        star = star.join(ends, ["mesh_id", "v"])
    star = star.select("mesh_id", "v", F.struct("ring", "rim", *carried).alias("end"))
    e = e.join(star.toDF("mesh_id", "lo", "a"), ["mesh_id", "lo"]).join(star.toDF("mesh_id", "hi", "b"), ["mesh_id", "hi"])
    tips = F.array_distinct(F.array("l.apex", "r.apex"))
    ok = (F.col("l.n") == 3) & (F.col("r.n") == 3) & (F.size(F.array_except(F.array_intersect("a.ring", "b.ring"), tips)) == 0)
    for apex in ("l.apex", "r.apex"):
        ok = ok & ~(F.array_contains("a.rim", F.col(apex)) & F.array_contains("b.rim", F.col(apex)))
    inner = (F.col("k") == 2) & (F.col("l.v") != F.col("r.v")) & (F.col("l.apex") != F.col("r.apex")) & ((F.size("a.rim") == 0) | (F.size("b.rim") == 0))
    return e.select("mesh_id", "lo", "hi", (ok & ((F.col("k") == 1) | inner)).alias("ok"), *(["a", "b"] if carried else []))


def both_ways(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows of edges (mesh_id, lo, hi) once for each direction, with src, dst and ``more``."""
    ways = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return rows.select("mesh_id", F.inline(ways), *more)


def collapse_candidates(m: MeshFrame) -> DataFrame:
    """mesh_id, src, dst, ok of both directions of every edge, as ``collapse_edges`` decides."""
    return both_ways(collapse_edges(m), F.col("ok"))


def collapse(m: MeshFrame, moves: DataFrame) -> MeshFrame:
    """Vertices moved into a neighbour: ``moves`` (mesh_id, src, dst), none of whose ends is an end or a neighbour
    of another's."""
    to = moves.select("mesh_id", F.col("src").alias("v"), F.col("dst").alias("w"))
    from .repair import drop_degenerate, relabelled

    out = drop_degenerate(relabelled(m, to))
    return MeshFrame(m.live_vertices.join(to, ["mesh_id", "v"], "left_anti").select(m.vertices.columns), out.faces)


def vertex_split(m: MeshFrame, mesh_id: int, v0: int, v1: int, left: int | None, right: int | None) -> MeshFrame:
    """The inverse of collapsing v0 into v1: faces of v1 on the turn from left to right go to v0, two faces join.

    v0 must be an isolated vertex, left and right neighbours of v1; None stands for the boundary.
    """
    ring = m.ordered_ring().where((F.col("mesh_id") == mesh_id) & (F.col("v") == v1)).first()
    if ring is None or left is not None and left not in ring["ring"] or right is not None and right not in ring["ring"]:
        raise ValueError("left and right must be neighbours of a vertex with one fan")
    turn = list(ring["ring"])  # one vertex's ring
    closed = not m.corners.where((F.col("mesh_id") == mesh_id) & (F.col("v") == v1) & (F.col("prev_v") == turn[-1]) & (F.col("next_v") == turn[0])).isEmpty()
    if closed:
        if left is None or right is None:
            raise ValueError("a closed fan has no boundary")
        k = turn.index(right)
        turn = turn[k:] + turn[:k]
        sector = turn[: turn.index(left) + 1]
    else:
        i = 0 if right is None else turn.index(right)
        j = len(turn) - 1 if left is None else turn.index(left)
        if j < i:
            raise ValueError("left must follow right")
        sector = turn[i : j + 1]
    steps = m.vertices.sparkSession.createDataFrame([(mesh_id, v1, a, b) for a, b in zip(sector, sector[1:], strict=False)], "mesh_id bigint, v bigint, prev_v bigint, next_v bigint")
    own = m.corners.join(steps, ["mesh_id", "v", "prev_v", "next_v"], "left_semi").select("mesh_id", "f", F.lit(True).alias("__own"))
    f = m.live_faces.join(own, ["mesh_id", "f"], "left")
    f = f.withColumn("verts", F.when(F.col("__own"), F.transform("verts", lambda x: F.when(x == v1, F.lit(v0).cast("bigint")).otherwise(x))).otherwise(F.col("verts"))).select(m.faces.columns)
    new = []
    if left is not None:
        new.append((mesh_id, 0, [v0, v1, left]))
    if right is not None:
        new.append((mesh_id, 1, [v1, v0, right]))
    rows = m.vertices.sparkSession.createDataFrame(new, "mesh_id bigint, k bigint, verts array<bigint>")
    return MeshFrame(m.vertices, f).add_faces(rows)
