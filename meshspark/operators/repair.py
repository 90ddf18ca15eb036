"""Repair: welding, dropping, orienting, splitting, and acceptance as a manifold mesh."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.functions.numbering import numbered
from meshspark.functions.shared import dropped, staged

from . import check, kernel
from .components import components
from .frame import MeshFrame
from .geometry import face_points
from .weld import leaders


@dataclass(frozen=True)
class RepairOptions:
    weld: bool = True
    weld_tolerance: float = 1e-10
    drop_degenerate: bool = True
    min_face_area: float = 0.0
    drop_duplicate: bool = True
    reorient: bool = True
    drop_unused: bool = True
    split_nonmanifold: bool = True
    min_component_faces: int = 0


def _cut(m: MeshFrame) -> MeshFrame:
    """The mesh with both tables staged."""
    return MeshFrame(staged(m.vertices, "vertices"), staged(m.faces, "faces"))


def relabelled(m: MeshFrame, ids: DataFrame) -> MeshFrame:
    """Faces moved from v to the ``w`` of ``ids`` (mesh_id, v, w); vertices stay."""
    c = m.live_faces.select("mesh_id", "f", F.posexplode("verts").alias("slot", "v")).join(ids, ["mesh_id", "v"], "left")
    lists = c.groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("w", "v").alias("w")))), lambda t: t["w"]).alias("verts"))
    return MeshFrame(m.vertices, m.live_faces.drop("verts").join(lists, ["mesh_id", "f"]).select(m.faces.columns))


def weld(m: MeshFrame, tol: float) -> MeshFrame:
    """Vertices within ``tol`` of a leader merged into it; tol <= 0 changes nothing."""
    if tol <= 0:
        return m
    ids = staged(leaders(m, tol).where("v <> leader").select("mesh_id", "v", F.col("leader").alias("w")), "weld")
    out = relabelled(m, ids)
    return MeshFrame(m.live_vertices.join(ids, ["mesh_id", "v"], "left_anti").select(m.vertices.columns), out.faces)


def drop_degenerate(m: MeshFrame, min_area: float | None = None) -> MeshFrame:
    """Without faces of under 3 or repeated vertices and, if min_area is given, of less area (by fans)."""
    ok = m.live_faces.where((F.size("verts") >= 3) & (F.size(F.array_distinct("verts")) == F.size("verts")))
    if min_area is None:
        return MeshFrame(m.vertices, ok)
    p = lambda i: F.get("pts", i)
    fan = F.aggregate(F.sequence(F.lit(1), F.size("pts") - 2), F.lit(0.0), lambda a, i: a + V.norm(V.cross(V.sub(p(i), p(F.lit(0))), V.sub(p(i + 1), p(F.lit(0))))) / 2)
    small = face_points(MeshFrame(m.vertices, ok)).where(fan < max(min_area, check.NO_AREA))
    return MeshFrame(m.vertices, ok.join(small.select("mesh_id", "f"), ["mesh_id", "f"], "left_anti").select(m.faces.columns))


def drop_duplicate(m: MeshFrame) -> MeshFrame:
    return MeshFrame(m.vertices, m.live_faces.join(check.duplicate_faces(m).select("mesh_id", "f"), ["mesh_id", "f"], "left_anti").select(m.faces.columns))


def drop_unused(m: MeshFrame) -> MeshFrame:
    """Without vertices of no face; ids stay (``compacted`` makes them dense)."""
    return MeshFrame(m.live_vertices.join(m.corners.select("mesh_id", "v"), ["mesh_id", "v"], "left_semi").select(m.vertices.columns), m.faces)


def flips(m: MeshFrame) -> DataFrame:
    """mesh_id, f of faces to turn so that each two-sided edge runs both ways, as in the component's least face.

    Faces are doubled, as they are and turned; neighbours that agree join like to like, the others crosswise.  A face
    is turned if, as it is, it hangs together with its component's least face turned.  Where a component can't be
    oriented both hang together and nothing is turned.
    """
    two = m.radial.where("n_faces = 2").select("mesh_id", F.col("first.f").alias("f"), F.col("last.f").alias("g"), (F.col("first.v0") == F.col("last.v0")).cast("int").alias("odd")).where("f <> g")
    node = lambda c, p: F.struct("mesh_id", F.col(c).alias("f"), p.cast("int").alias("turned"))
    links = two.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).select(node("f", F.col("p")).alias("a"), node("g", F.col("p").bitwiseXOR(F.col("odd"))).alias("b"))
    return components(links).where("node.turned = 0 and component.turned = 1").select("node.mesh_id", "node.f")


def reorient(m: MeshFrame) -> MeshFrame:
    turn = staged(flips(m), "flips").withColumn("__turn", F.lit(True))
    f = m.live_faces.join(turn, ["mesh_id", "f"], "left")
    return MeshFrame(m.vertices, f.withColumn("verts", F.when(F.col("__turn"), F.reverse("verts")).otherwise(F.col("verts"))).select(m.faces.columns))


def fans(m: MeshFrame) -> DataFrame:
    """mesh_id, f, slot, v, fan: corners of a vertex that hang together over two-sided edges that run both ways."""
    c = m.corners
    two = m.radial.where("n_faces = 2 and first.v0 <> last.v0").select("mesh_id", "lo", "hi")
    side = c.select("mesh_id", "f", "slot", "n", "v", "next_v", F.least("v", "next_v").alias("lo"), F.greatest("v", "next_v").alias("hi")).join(two, ["mesh_id", "lo", "hi"])
    here = side.select("mesh_id", "v", F.col("next_v").alias("w"), F.struct("mesh_id", "f", "slot").alias("a"), F.struct("mesh_id", "f", ((F.col("slot") + 1) % F.col("n")).cast("int").alias("slot")).alias("a1"))
    there = here.select("mesh_id", F.col("w").alias("v"), F.col("v").alias("w"), F.col("a").alias("b"), F.col("a1").alias("b1"))
    # At v the side v -> w starts here and the side w -> v ends there.
    links = here.join(there, ["mesh_id", "v", "w"]).select("a", F.col("b1").alias("b"))
    found = components(links).select("node.mesh_id", "node.f", "node.slot", F.struct("component.f", "component.slot").alias("fan"))
    own = F.struct("f", "slot")
    return c.select("mesh_id", "f", "slot", "v").join(found, ["mesh_id", "f", "slot"], "left").withColumn("fan", F.coalesce("fan", own))


def split_fans(m: MeshFrame) -> MeshFrame:
    """Every fan of a vertex gets a vertex of its own; ids follow the first corner of each fan, unused ones go."""
    c = staged(fans(m), "fans")
    heads = numbered(c.select("mesh_id", "fan", "v").distinct(), "w", F.col("fan.f"), F.col("fan.slot"), F.col("v"))
    c = c.join(heads, ["mesh_id", "fan", "v"])
    lists = c.groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "w"))), lambda t: t["w"]).alias("verts"))
    v = m.live_vertices.join(heads.select("mesh_id", "v", "w"), ["mesh_id", "v"]).withColumn("v", F.col("w")).select(m.vertices.columns)
    return MeshFrame(v, m.live_faces.drop("verts").join(lists, ["mesh_id", "f"]).select(m.faces.columns))


def drop_small_components(m: MeshFrame, min_faces: int) -> MeshFrame:
    """Without face components of under ``min_faces`` faces; up to 1 changes nothing."""
    if min_faces <= 1:
        return m
    c = staged(check.face_components(m), "face-components")
    small = c.groupBy("mesh_id", "component").agg(F.count("*").alias("n")).where(F.col("n") < min_faces)
    gone = c.join(small, ["mesh_id", "component"]).select("mesh_id", "f")
    return MeshFrame(m.vertices, m.live_faces.join(gone, ["mesh_id", "f"], "left_anti").select(m.faces.columns))


def remove_small_components(m: MeshFrame, min_faces: int) -> MeshFrame:
    """As above on an accepted mesh, with its vertices, and compacted."""
    return m if min_faces <= 1 else drop_unused_of(m, drop_small_components(m, min_faces)).compacted()


def drop_unused_of(before: MeshFrame, after: MeshFrame) -> MeshFrame:
    """``after`` without the vertices that had faces in ``before`` and have none now."""
    lost = before.corners.select("mesh_id", "v").distinct().join(after.corners.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti")
    return MeshFrame(after.vertices.join(lost, ["mesh_id", "v"], "left_anti").select(after.vertices.columns), after.faces)


def verdicts(m: MeshFrame) -> DataFrame:
    """mesh_id, f, reason: why a manifold mesh refuses a face when faces are inserted in the order of f, or null.

    Reasons are degenerate, complex vertex (already surrounded), complex edge (side taken) and patch (would close one
    of several fans).  A face with no vertex of several fans or repeated sides is always taken; only the faces around
    such vertices are inserted face by face, each group of them that hangs together over these vertices on its own.
    """
    rows = m.live_faces.select("mesh_id", "f", "verts")
    whole = (F.size("verts") >= 3) & (F.size(F.array_distinct("verts")) == F.size("verts"))
    sound = MeshFrame(m.vertices, rows.where(whole))
    odd = staged(sound.corners.select("mesh_id", "f", "v").join(check.nonmanifold_vertices(sound), ["mesh_id", "v"], "left_semi"), "odd-corners")
    hub = odd.groupBy("mesh_id", "v").agg(F.min("f").alias("g"))
    at = lambda c: F.struct("mesh_id", F.col(c).alias("f"))
    part = components(odd.join(hub, ["mesh_id", "v"]).select(at("f").alias("a"), at("g").alias("b"))).select("node.mesh_id", "node.f", F.col("component.f").alias("part"))
    slow = rows.join(part, ["mesh_id", "f"]).select("mesh_id", "part", "f", "verts").groupBy("mesh_id", "part").applyInArrow(kernel.accept, "mesh_id bigint, f bigint, reason string")
    reasons = slow.where("reason is not null").unionByName(rows.where(~whole).select("mesh_id", "f", F.lit("degenerate").alias("reason")))
    return rows.select("mesh_id", "f").join(reasons, ["mesh_id", "f"], "left")


def accepted(m: MeshFrame) -> DataFrame:
    """mesh_id, f, accepted: which faces a manifold mesh takes when they are inserted in the order of f."""
    return verdicts(m).select("mesh_id", "f", F.col("reason").isNull().alias("accepted"))


def insert_faces(m: MeshFrame, rows: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """(the mesh with those of ``rows`` (mesh_id, k, verts) that keep it manifold, inserted in the order of k;
    mesh_id, k, reason of every row)."""
    top = m.faces.groupBy("mesh_id").agg((F.max("f") + 1).alias("__f"))
    keyed = numbered(rows, "f", F.col("k")).join(top, "mesh_id", "left").withColumn("f", F.col("f") + F.coalesce("__f", F.lit(0))).drop("__f")
    keyed = staged(keyed, "new-faces")
    both = MeshFrame(m.vertices, m.live_faces.select("mesh_id", "f", "verts").unionByName(keyed.select("mesh_id", "f", "verts")))
    told = staged(keyed.join(verdicts(both), ["mesh_id", "f"]), "told-faces")
    return m.add_faces(told.where("reason is null").select(*rows.columns)), told.select("mesh_id", "k", "reason")


def to_mesh(m: MeshFrame, split_nonmanifold: bool = True) -> tuple[MeshFrame, DataFrame]:
    """(the mesh of accepted faces; mesh_id, f, reason of rejected ones); with split, rejected faces get own vertices."""
    rejects = staged(verdicts(m).where("reason is not null"), "rejected")
    keep = m.live_faces.join(rejects, ["mesh_id", "f"], "left_anti").select(m.faces.columns)
    if not split_nonmanifold:
        return MeshFrame(m.live_vertices, keep), rejects
    again = m.live_faces.join(rejects, ["mesh_id", "f"], "left_semi").where((F.size("verts") >= 3) & (F.size(F.array_distinct("verts")) == F.size("verts")))
    c = numbered(again.select("mesh_id", "f", F.posexplode("verts").alias("slot", "v")), "k", F.col("f"), F.col("slot"))
    top = m.live_vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("__top"))
    c = c.join(top, "mesh_id").withColumn("w", F.col("k") + F.col("__top"))
    new_v = m.live_vertices.join(c.select("mesh_id", "v", "w"), ["mesh_id", "v"]).withColumn("v", F.col("w")).select(m.vertices.columns)
    lists = c.groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "w"))), lambda t: t["w"]).alias("verts"))
    new_f = again.drop("verts").join(lists, ["mesh_id", "f"]).select(m.faces.columns)
    return MeshFrame(m.live_vertices.unionByName(new_v), keep.unionByName(new_f)), rejects


def repaired(soup: MeshFrame, options: RepairOptions = RepairOptions(), by_area: bool = True) -> tuple[MeshFrame, DataFrame]:
    """(a clean soup, one report row per mesh): weld, degenerate, duplicate, small parts, orient, split, unused."""
    o, m, tallies = options, soup, []

    def tally(before: MeshFrame, after: MeshFrame, part: str, name: str) -> MeshFrame:
        after = _cut(after)
        n = lambda x: getattr(x, part).groupBy("mesh_id").agg(F.count("*").alias("n"))
        tallies.append((name, n(before).join(n(after).withColumnRenamed("n", "m"), "mesh_id", "left").select("mesh_id", F.abs(F.col("n") - F.coalesce("m", F.lit(0))).alias(name))))
        return after

    m = _cut(MeshFrame(m.live_vertices, m.live_faces))
    start = m
    if o.weld:
        m = tally(m, weld(m, o.weld_tolerance), "vertices", "vertices_merged")
    if o.drop_degenerate:
        m = tally(m, drop_degenerate(m, o.min_face_area if by_area else None), "faces", "degenerate_removed")
    if o.drop_duplicate:
        m = tally(m, drop_duplicate(m), "faces", "duplicate_removed")
    if o.min_component_faces > 1:
        m = tally(m, drop_small_components(m, o.min_component_faces), "faces", "component_faces_removed")
    tallies.append(("nonmanifold_edges", check.nonmanifold_edges(m).groupBy("mesh_id").agg(F.count("*").alias("nonmanifold_edges"))))
    if o.reorient:
        turned = staged(flips(m), "flips")
        tallies.append(("faces_flipped", turned.groupBy("mesh_id").agg(F.count("*").alias("faces_flipped"))))
        m = _cut(reorient(m))
    if o.split_nonmanifold:
        m = tally(drop_unused(m), split_fans(m), "vertices", "vertices_split")
    elif o.drop_unused:
        m = tally(m, drop_unused(m), "vertices", "vertices_removed")
    report = start.vertices.select("mesh_id").distinct()
    for _, rows in tallies:
        report = report.join(rows, "mesh_id", "left")
    report = report.na.fill(0)
    names = [n for n, _ in tallies if n != "nonmanifold_edges"]
    return m.compacted(), report.withColumn("changed", sum((F.col(n) for n in names), F.lit(0)) > 0)


def load_and_repair(soup: MeshFrame, options: RepairOptions = RepairOptions()) -> tuple[MeshFrame, DataFrame]:
    """(the manifold mesh of a repaired soup, its report with faces_split and faces_failed)."""
    clean, report = repaired(soup, options)
    mesh, rejects = to_mesh(clean, options.split_nonmanifold)
    return mesh, _with_rejects(report, rejects, "reason <> 'degenerate'" if options.split_nonmanifold else "false")


def load_and_repair_path(spark: SparkSession, path: str, options: RepairOptions = RepairOptions()) -> tuple[MeshFrame, DataFrame]:
    """As above from mesh files: a soup is read, without welding, then repaired."""
    from meshspark.sources import files

    return load_and_repair(files.read(spark, path, soup=True), options)


def _with_rejects(report: DataFrame, rejects: DataFrame, split: str) -> DataFrame:
    n = rejects.groupBy("mesh_id").agg(F.count_if(F.expr(split)).alias("faces_split"), F.count_if(~F.expr(split)).alias("faces_failed"))
    report = report.join(n, "mesh_id", "left").na.fill(0)
    return report.withColumn("changed", F.col("changed") | (F.col("faces_split") + F.col("faces_failed") > 0))


def repair_mesh(m: MeshFrame, options: RepairOptions = RepairOptions()) -> tuple[MeshFrame, DataFrame]:
    """(the rebuilt mesh, one report row per mesh): weld, degenerate, duplicate, orient, unused, then insertion of the
    faces in order, without those that are refused.  Areas, small parts and fans are not looked at here."""
    plain = replace(options, min_face_area=0.0, min_component_faces=0, split_nonmanifold=False)
    clean, report = repaired(m, plain, by_area=False)
    mesh, rejects = to_mesh(clean, False)
    return mesh, _with_rejects(report.drop("nonmanifold_edges"), rejects, "false")


def report_text(report: DataFrame) -> DataFrame:
    """mesh_id, text: what a repair did, in words."""
    names = [c for c in report.columns if c not in ("mesh_id", "changed")]
    parts = [F.when(F.col(c) > 0, F.concat(F.lit(c.replace("_", " ") + " "), F.col(c).cast("string"))) for c in names]
    return report.select("mesh_id", F.when(F.col("changed"), F.concat_ws(", ", *parts)).otherwise("nothing to repair").alias("text"))


def hole_caps(m: MeshFrame, max_edges: int = 0, starts: DataFrame | None = None) -> DataFrame:
    """mesh_id, loop, verts, k: a fan of triangles for every boundary loop of 3 to ``max_edges`` edges (0: any).

    A fan starts at the loop's least half-edge, which names it, or at the least of ``starts`` (mesh_id, h); loops with
    none of these get no fan.  Loops are put in order by doubling: after k rounds a half-edge knows the one 2**k steps
    on, so loops of any length take a logarithmic number of rounds.
    """
    h = staged(m.open_halfedges().select("mesh_id", "h", "src", "next_h"), "open-sides")
    at = lambda c: F.struct("mesh_id", F.col(c).alias("h"))
    part = components(h.select(at("h").alias("a"), at("next_h").alias("b"))).select("node.mesh_id", "node.h", F.col("component.h").alias("part"))
    first = F.min("h") if starts is None else F.min(F.when(F.col("start"), F.col("h")))
    named = part if starts is None else part.join(starts.select("mesh_id", "h", F.lit(True).alias("start")), ["mesh_id", "h"], "left")
    fit = named.groupBy("mesh_id", "part").agg(first.alias("loop"), F.count("*").alias("n_edges")).where("loop is not null and n_edges >= 3" + (f" and n_edges <= {max_edges}" if max_edges else ""))
    rank = h.join(part, ["mesh_id", "h"]).join(fit, ["mesh_id", "part"])
    # Steps from a half-edge to the loop's first one.
    rank = staged(rank.select("mesh_id", "h", "src", "loop", "n_edges", F.when(F.col("h") == F.col("loop"), F.col("h")).otherwise(F.col("next_h")).alias("to"), F.when(F.col("h") == F.col("loop"), 0).otherwise(1).cast("long").alias("d")), "loop-rank")
    longest = rank.agg(F.max("n_edges")).first()[0] or 0
    for _ in range(max(0, int(longest - 1).bit_length())):
        far = rank.select("mesh_id", F.col("h").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        old, rank = rank, staged(rank.join(far, ["mesh_id", "to"]).select("mesh_id", "h", "src", "loop", "n_edges", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d")), "loop-rank")
        dropped(old)
    ring = rank.withColumn("k", F.when(F.col("d") == 0, 0).otherwise(F.col("n_edges") - F.col("d")))
    first = ring.where("k = 0").select("mesh_id", "loop", F.col("src").alias("a"))
    nxt = ring.select("mesh_id", "loop", (F.col("k") - 1).alias("k"), F.col("src").alias("c"))
    tri = ring.where("k >= 1").join(nxt, ["mesh_id", "loop", "k"]).join(first, ["mesh_id", "loop"])
    return tri.select("mesh_id", "loop", F.array("a", F.col("src"), "c").alias("verts"), "k")


def fill_holes(m: MeshFrame, max_edges: int = 0) -> MeshFrame:
    """With the caps of all holes of up to ``max_edges`` edges (0: any), as far as they keep the mesh manifold.

    What a refused triangle leaves open is tried again from its next half-edge that was open at the start, and so on
    until each of them is covered or was tried.  Only meshes with a refused triangle take further rounds.
    """
    caps = staged(hole_caps(m, max_edges), "caps")
    filled, told = _capped(m, caps)
    again = staged(told.where("reason is not null").select("mesh_id").distinct(), "refused")
    if again.isEmpty():
        return filled
    of = lambda rows: rows.join(again, "mesh_id", "left_semi").select(rows.columns)
    part = MeshFrame(of(m.live_vertices), staged(of(filled.faces), "faces"))
    left = of(m.open_halfedges().select("mesh_id", "h"))
    # New faces follow all others, so the half-edges that there were keep their ids.
    while not caps.isEmpty():
        left = staged(left.join(caps.select("mesh_id", F.col("loop").alias("h")), ["mesh_id", "h"], "left_anti"), "starts")
        caps = staged(hole_caps(part, max_edges, left), "caps")
        part = replace(part, faces=staged(_capped(part, caps)[0].faces, "faces"))
    rest = filled.faces.join(again, "mesh_id", "left_anti").select(filled.faces.columns)
    return replace(filled, faces=rest.unionByName(part.faces))


def fill_hole(m: MeshFrame, mesh_id: int, h: int, max_edges: int = 0) -> MeshFrame:
    """With the cap of the hole that half-edge ``h`` borders, a fan from there; unchanged if it borders none, or a larger one."""
    one = m.half_ids.where((F.col("mesh_id") == mesh_id) & (F.col("h") == h)).select("mesh_id", "h")
    return _capped(m, hole_caps(m, max_edges, one))[0]


def _capped(m: MeshFrame, caps: DataFrame) -> tuple[MeshFrame, DataFrame]:
    rows = numbered(caps.withColumnRenamed("k", "step"), "k", F.col("loop"), F.col("step")).select("mesh_id", "k", "verts")
    return insert_faces(m, rows)
