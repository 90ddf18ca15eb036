"""Mesh operators on hand-built meshes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshspark.functions.vec import Vec3
from meshspark.operators import check, decimate, edit, frame, geometry, repair, smooth, subdivide, walk
from meshspark.operators.frame import MeshFrame
from meshspark.operators.kernel import Fans
from meshspark.operators.weld import leaders
from meshspark.plans import registry
from meshspark.sources import files

TETRA = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [[0, 2, 1], [0, 1, 3], [1, 2, 3], [2, 0, 3]])
QUAD = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [[0, 1, 2], [0, 2, 3]])
BOX = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], [[0, 3, 2, 1], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]])


def mesh(spark, shape):
    return MeshFrame.from_arrays(spark, *shape)


def counts(m):
    r = m.counts().first()
    return r["n_vertices"], r["n_edges"], r["n_faces"]


def test_vec3():
    a, b = Vec3(1, 0, 0), Vec3(0, 1, 0)
    assert a.cross(b) == (0, 0, 1) and a.dot(b) == 0 and (a + b).norm() == math.sqrt(2) and Vec3().normalized() == (0, 0, 0)


def test_report_of_closed_mesh(spark):
    r = check.report(mesh(spark, TETRA), intersections=True).first()
    assert (r["n_edges"], r["euler"], r["genus"], r["n_components"], r["is_closed"], r["ok"]) == (6, 2, 0, 1, True, True)


def test_flip_and_split(spark):
    m = mesh(spark, QUAD)
    e = m.edges.where("not is_boundary").select("mesh_id", "e")
    turned = edit.flip_edges(m, e)
    assert counts(turned) == (4, 5, 2)
    assert turned.radial.where("n_faces = 2").select("lo", "hi").first() == (1, 3)
    assert counts(edit.split_edges(m, e)) == (5, 8, 4)
    assert counts(edit.split_faces(m, m.faces)) == (6, 11, 6)
    with pytest.raises(ValueError):
        edit.flip_edges(m, m.edges.where("is_boundary").select("mesh_id", "e"))


def test_edges_and_halfedges_are_derived_once(spark):
    m = mesh(spark, BOX)
    for rows, n in ((m.edges, 12), (m.halfedges, 24)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and rows.count() == n


def made(monkeypatch, *modules):
    """The labels of the tables that are staged from now on."""
    labels = []
    for x in modules:
        monkeypatch.setattr(x, "staged", lambda df, label="step", real=x.staged: labels.append(label) or real(df, label))
    return labels


def walked(kind, step):
    return lambda m: step(walk.Walk.over(m, kind, m.half_ids if kind == "halfedge" else m.vertices if kind == "vertex" else m.faces))


LEAST = {
    "walk_boundary": (walked("halfedge", lambda w: w.is_boundary()), {"edges", "half-sides"}),
    "walk_faces": (walked("face", lambda w: w.faces().rows), {"edges", "half-sides"}),
    "walk_vertices": (walked("vertex", lambda w: w.vertices().rows), {"edges"}),
    "boundary_loops": (check.boundary_loops, {"edges", "half-sides", "open-sides"}),
    "face_edges": (MeshFrame.face_edges, {"edges", "half-sides"}),
    "face_halfedges": (MeshFrame.face_halfedges, {"edges", "half-sides"}),
    "find_halfedge_lookup": (lambda m: m.find_halfedge(m.half_ids.select("mesh_id", F.col("src").alias("a"), F.col("dst").alias("b"))), {"edges"}),
    "vertex_incoming_halfedges": (lambda m: m.vertex_halfedges(True), {"edges"}),
    "vertex_outgoing_halfedges": (MeshFrame.vertex_halfedges, {"edges"}),
}


@pytest.mark.parametrize("name", LEAST)
def test_only_the_tables_that_are_needed_are_made(spark, monkeypatch, name):
    of, needed = LEAST[name]
    labels = made(monkeypatch, frame, check, walk)
    assert not of(mesh(spark, BOX)).isEmpty() and set(labels) == needed


def test_halfedges_are_listed_once(spark):
    m = mesh(spark, ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [[0, 1, 2], [0, 1, 3]]))
    assert len(m.vertex_halfedges().where("v = 0").first()["halfedges"]) == 3
    assert m.find_halfedge(m.vertices.where("v = 0").selectExpr("mesh_id", "v as a", "1l as b")).count() == 1


def test_halfedges_of_the_boundary_turn_around_it(spark):
    m = mesh(spark, QUAD)
    h = {r["h"]: r for r in m.halfedges.collect()}
    assert len(h) == 10 and all(h[r["next_h"]]["prev_h"] == x and h[r["next_h"]]["src"] == r["dst"] and h[r["next_h"]]["f"] == r["f"] for x, r in h.items())
    assert "Join" not in m.halfedges._jdf.queryExecution().executedPlan().toString() and {r["h"]: (r["next_h"], r["prev_h"]) for r in m.open_halfedges().collect()} == {x: (r["next_h"], r["prev_h"]) for x, r in h.items() if r["f"] is None}


def test_vertices_of_several_fans_take_no_join(spark):
    bowtie = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (-1, 0, 0), (-1, -1, 0)], [[0, 1, 2], [0, 3, 4]])
    rows = check.nonmanifold_vertices(mesh(spark, bowtie))
    assert [r["v"] for r in rows.collect()] == [0] and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["v"] for r in mesh(spark, bowtie).ordered_ring().collect()) == [1, 2, 3, 4]


def test_corners_are_never_collected_in_the_driver(spark):
    plan = geometry.face_points(mesh(spark, TETRA))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_is_valid_joins_offenders_only(spark):
    rows = check.is_valid(mesh(spark, TETRA))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.first()["valid"] and "Generate" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize("of", [subdivide.butterfly_subdivide, subdivide.loop_subdivide, subdivide.sqrt3_subdivide])
def test_last_subdivision_makes_what_is_read(spark, monkeypatch, of):
    labels = made(monkeypatch, subdivide)
    assert of(mesh(spark, TETRA)).vertices.count() > 4 and not labels
    assert of(mesh(spark, TETRA), 2).faces.count() > 16 and labels == ["vertices", "faces"]


def test_report_joins_tallies_only(spark):
    plan = check.report(mesh(spark, TETRA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_soup_is_repaired(spark):
    bowtie = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (-1, 0, 0), (-1, -1, 0)], [[0, 1, 2], [0, 3, 4]])
    m, r = repair.load_and_repair(mesh(spark, bowtie))
    assert r.first()["vertices_split"] == 1 and counts(m) == (6, 6, 2)
    cracked = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [[0, 1, 2], [4, 3, 5]])
    m, r = repair.load_and_repair(mesh(spark, cracked))
    assert r.first()["vertices_merged"] == 2 and counts(m) == (4, 5, 2)
    spine = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1)], [[0, 1, 2], [0, 1, 3], [0, 1, 4]])
    m, r = repair.load_and_repair(mesh(spark, spine))
    assert r.first()["nonmanifold_edges"] == 1 and m.faces.count() == 3 and check.nonmanifold_vertices(m).isEmpty()


def test_fill_holes_by_size(spark):
    m = mesh(spark, BOX)
    assert repair.hole_caps(m, 3).isEmpty()
    assert check.report(repair.fill_holes(m, 4)).first()["is_closed"]


@pytest.mark.parametrize("of, expected", [(subdivide.loop_subdivide, (10, 24, 16)), (subdivide.sqrt3_subdivide, (8, 18, 12)), (subdivide.catmull_clark, (14, 24, 12)), (subdivide.butterfly_subdivide, (10, 24, 16))])
def test_subdivision_counts(spark, of, expected):
    m = of(mesh(spark, TETRA))
    assert counts(m) == expected and check.nonmanifold_vertices(m).isEmpty() and check.incoherent_edges(m).isEmpty()


def test_decimation_keeps_a_sphere(spark):
    m = decimate.quadric_decimate(subdivide.loop_subdivide(mesh(spark, TETRA)), 12)
    v, e, f = counts(m)
    assert v - e + f == 2 and 4 <= f <= 12


def test_smoothing_and_longest_edge(spark):
    m = subdivide.loop_subdivide(mesh(spark, TETRA))
    area = lambda x: geometry.mesh_measures(x).first()["surface_area"]
    assert area(smooth.laplacian_smooth(m, 2)) < area(m)
    long = MeshFrame.from_arrays(spark, [(0, 0, 0), (4, 0, 0), (0, 4, 0), (4, 4, 0)], [[0, 1, 2], [1, 3, 2]])
    fine = subdivide.longest_edge_subdivide(long, 1.5)
    assert geometry.edge_measures(fine).agg(F.max("length")).first()[0] <= 1.5
    with pytest.raises(ValueError):
        subdivide.longest_edge_subdivide(long, 0)


def test_crossing_triangles(spark):
    shape = ([(-1, 0, -1), (1, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (2, 0, 0)], [[0, 1, 2], [3, 4, 5]])
    assert check.self_intersections(mesh(spark, shape)).count() == 1


def test_leaders_equal_the_sequential_scan(spark):
    random.seed(4)
    xs = [round(random.random() * 6, 2) for _ in range(60)]
    m = MeshFrame.from_arrays(spark, [(x, 0, 0) for x in xs], [])
    tol, lead, want = 0.3, [], {}
    for i, x in enumerate(xs):
        near = sorted((math.floor(xs[j] / tol) - math.floor(x / tol), j) for j in lead if (xs[j] - x) ** 2 <= tol * tol)
        want[i] = near[0][1] if near else i
        if not near:
            lead.append(i)
    assert {r["v"]: r["leader"] for r in leaders(m, tol).collect()} == want


def test_faces_are_accepted_in_order():
    f = Fans()
    got = []
    for verts in ([0, 0, 1], [0, 1, 2], [0, 1, 3], [1, 0, 4], [0, 3, 5]):
        got.append(f.fits(verts))
        if got[-1]:
            f.add(verts)
    assert got == [False, True, False, True, True]


@pytest.mark.parametrize("kind, binary", [("obj", False), ("off", False), ("ply", True), ("stl", True)])
def test_round_trip(spark, tmp_path, kind, binary):
    files.write(mesh(spark, TETRA), f"file://{tmp_path}", kind, binary)
    assert counts(files.read(spark, f"file://{tmp_path}")) == (4, 6, 4)


def test_ply_of_the_other_byte_order_is_refused():
    with pytest.raises(ValueError):
        files.parse_ply(b"ply\nformat binary_big_endian 1.0\nelement vertex 0\nend_header\n")


def test_vetoes_do_not_repeat_each_other(spark, monkeypatch):
    plans, staged = [], decimate.staged
    monkeypatch.setattr(decimate, "staged", lambda df, label="step": plans.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti"))) or staged(df, label))
    d = decimate.Decimator(mesh(spark, TETRA)).add_module(decimate.ModQuadric()).add_module(decimate.ModNormalFlipping(1.4)).add_module(decimate.ModAspectRatio(20.0)).add_module(decimate.ModEdgeLength(4.0))
    assert d.decimate_to_faces(4) == 0 and [n for label, n in plans if label == "costed"] == [1]


def test_decimation_queries_ask_for_the_whole_job(spark, monkeypatch):
    from meshspark.operators import decimate
    from meshspark.plans import registry

    asked = []
    monkeypatch.setattr(decimate, "quadric_decimate", lambda m, n: asked.append(n) or m)
    monkeypatch.setattr(decimate.Decimator, "decimate_to_faces", lambda self, n: asked.append(n))
    for name in ("decimate_quadric", "decimate_modules"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [128, 160]


POINTS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (2, 0, 0), (0, 2, 0)]


@pytest.mark.parametrize("faces, reasons", [([[0, 1, 2], [0, 1, 3]], [None, "complex edge"]), ([[0, 0, 1], [0, 1, 2]], ["degenerate", None]), ([[0, 1, 2], [0, 3, 4], [0, 5, 6]], [None, None, None]), ([[0, 1, 2], [0, 2, 3], [0, 3, 1], [0, 4, 5]], [None, None, None, "complex vertex"]), ([[0, 1, 2], [0, 3, 4], [0, 2, 1]], [None, None, "patch"])])
def test_input_that_is_not_manifold(spark, faces, reasons):
    m = MeshFrame.from_arrays(spark, POINTS, faces)
    assert [r["reason"] for r in repair.verdicts(m).orderBy("f").collect()] == reasons
    if "complex edge" in reasons:
        assert not check.report(m).first()["ok"] and not check.is_valid(m).first()["valid"]
    assert repair.to_mesh(m, False)[0].faces.count() == reasons.count(None)


def turned(m):
    return sorted(min(tuple(r["verts"][i:] + r["verts"][:i]) for i in range(3)) for r in m.faces.collect())


@pytest.mark.parametrize("left, right", [(3, 1), (1, 3), (5, 2)])
def test_vertex_split_is_the_inverse_of_collapse(spark, left, right):
    fan = MeshFrame.from_arrays(spark, [(0, 0, 0)] + [(1, i, 0) for i in range(6)] + [(0, 0, 9)], [[0, i + 1, (i + 1) % 6 + 1] for i in range(6)])
    split = edit.vertex_split(fan, 0, 7, 0, left, right)
    assert counts(split) == (8, 15, 8) and check.incoherent_edges(split).isEmpty() and check.nonmanifold_vertices(split).isEmpty()
    back = edit.collapse(split, spark.createDataFrame([(0, 7, 0)], "mesh_id bigint, src bigint, dst bigint"))
    assert turned(back) == turned(fan)


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    from meshspark.operators import components as c

    rounds = []
    one = c.contracted
    monkeypatch.setattr(c, "FEW", 50)
    monkeypatch.setattr(c, "contracted", lambda e, turn: rounds.append(turn) or one(e, turn))
    path = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 5000 < 4999")
    got = c.components(path).groupBy("component").agg(F.count("*").alias("n")).orderBy("component").collect()
    assert [tuple(r) for r in got] == [(0, 5000), (5000, 5000)] and len(rounds) <= 14
    alone = c.components(spark.createDataFrame([(3, 3), (None, 1)], "a bigint, b bigint"))
    assert [tuple(r) for r in alone.collect()] == [(3, 3)]


def test_walks_and_flags(spark):
    from meshspark.operators.walk import Tables, smart

    m = mesh(spark, QUAD)
    t = Tables(m)
    assert smart(t, "vertex", 0).vertices().ids() == [1, 2, 3] and smart(t, "face", 0).faces().ids() == [1]
    assert smart(t, "face", 0).halfedge().next().opp().edge().ids() == smart(t, "face", 0).halfedge().next().edge().ids()
    assert smart(t, "vertex", 1).is_boundary().first()["is_boundary"] and smart(t, "face", 0).measures().first()["area"] == 0.5
    with pytest.raises(TypeError):
        smart(t, "vertex", 0).next()
    flagged = m.change_status("edge", "locked", m.edges.where("e = 1").select("mesh_id", "e", F.lit(True).alias("on")))
    assert [r["locked"] for r in (smart(flagged, "edge", e).flags().first() for e in (0, 1))] == [False, True]


def test_faces_are_inserted_and_holes_filled_as_far_as_manifold(spark):
    m = mesh(spark, QUAD)
    rows = spark.createDataFrame([(0, 0, [0, 1, 3]), (0, 1, [1, 0, 3])], "mesh_id bigint, k bigint, verts array<bigint>")
    grown, told = repair.insert_faces(m, rows)
    assert [r["reason"] for r in told.orderBy("k").collect()] == ["complex edge", None] and grown.faces.count() == 3
    box = mesh(spark, BOX)
    h = box.halfedges.where("f is null").agg(F.max("h")).first()[0]
    assert check.report(repair.fill_hole(box, 0, h)).first()["is_closed"]


def test_bulk_copies(spark):
    m = mesh(spark, QUAD)
    points, triangles = m.to_numpy()
    assert points.tolist() == [list(map(float, p)) for p in QUAD[0]] and triangles.tolist() == QUAD[1]
    with pytest.raises(ValueError):
        mesh(spark, BOX).triangles()
    with pytest.raises(ValueError):
        m.set_points(m.positions().where("v > 0"))
    split = edit.split_faces(m.add_vertices(spark.createDataFrame([(0, 0, 0.5, 0.2, 0.0)], "mesh_id bigint, k bigint, x double, y double, z double")), spark.createDataFrame([(0, 0, 4)], "mesh_id bigint, f bigint, v bigint"))
    assert split.faces.count() == 4 and split.vertices.count() == 5


@pytest.mark.parametrize("faces, ok", [([[0, 1, 2], [0, 1, 3], [1, 0, 4]], False), ([[0, 1, 2], [0, 1, 3]], False), ([[0, 1, 2], [1, 0, 3], [0, 0, 1]], False), ([[0, 1, 2]], False), ([[0, 1, 2], [0, 2, 3], [0, 3, 1], [1, 3, 4], [3, 2, 5], [2, 1, 6]], True)])
def test_collapse_of_one_edge(spark, faces, ok):
    e = edit.collapse_edges(MeshFrame.from_arrays(spark, POINTS, faces)).where("lo = 0 and hi = 1").collect()
    assert [r["ok"] for r in e] == [ok]


def test_butterfly_has_one_vertex_for_an_edge_of_three_faces(spark):
    m = MeshFrame.from_arrays(spark, POINTS, [[0, 1, 2], [0, 1, 3], [1, 0, 4]])
    got = subdivide.butterfly_subdivide(m).vertices
    assert got.count() == got.select("v").distinct().count() == len(POINTS) + m.edges.count()


def test_butterfly_weights(spark):
    octa = [(1, 0, 0), (0, 2, 0), (-3, 0, 0), (0, -4, 0), (0, 0, 5), (0, 0, -6)]
    faces = [f for i in range(4) for f in ([i, (i + 1) % 4, 4], [(i + 1) % 4, i, 5])]
    for shape, fallback, expected in ((faces, "reference", (0.875, 1.5, -0.125)), (faces[:2] + faces[4:], "reference", (0.5, 1.0, -0.125)), (faces[:2] + faces[4:], "midpoint", (0.5, 1.0, 0.0))):
        m = MeshFrame.from_arrays(spark, octa, shape)
        at = subdivide.butterfly_edge_points(m, fallback).join(m.edges.where("lo = 0 and hi = 1"), ["mesh_id", "e"])
        assert tuple(at.first()["at"]) == expected and "Broadcast" not in subdivide.butterfly_edge_points(m)._jdf.queryExecution().executedPlan().toString()


def test_half_edges_of_a_face_take_no_join(spark):
    m = mesh(spark, BOX)
    for rows in (m.face_halfedges(), m.face_edges()):
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and all(len(set(r[2])) == 4 for r in rows.collect())
    first = mesh(spark, QUAD).face_edges().where("f = 0").first()["edges"]
    ends = {r["e"]: (r["v0"], r["v1"]) for r in mesh(spark, QUAD).edges.collect()}
    assert [ends[e] for e in first] == [(2, 0), (0, 1), (1, 2)]


def test_links_of_a_degenerate_face_are_listed_once(spark):
    h = MeshFrame.from_arrays(spark, POINTS, [[0, 0, 1], [0, 1, 2]]).halfedges.where("f is not null")
    assert h.count() == h.select("f", "slot", "h").distinct().count() == 7
    of = {(r["f"], r["slot"]): r for r in h.orderBy("h", ascending=False).collect()}
    assert all(of[f, s]["next_h"] == of[f, (s + 1) % 3]["h"] and of[f, s]["prev_h"] == of[f, (s + 2) % 3]["h"] for f, s in of)


def test_sqrt3_faces_take_one_join_of_sides(spark):
    rows = subdivide.sqrt3_subdivide(mesh(spark, TETRA)).faces
    plan = rows._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Join ") == 2 and "SortMergeJoin" in plan.executedPlan().toString() and rows.count() == 12
    pillow = MeshFrame.from_arrays(spark, POINTS, [[0, 1, 2], [0, 2, 1]])
    assert sorted(sorted(r["verts"]) for r in subdivide.sqrt3_subdivide(pillow).faces.collect()) == [[0, 2, 7], [0, 2, 8], [0, 7, 8], [1, 2, 7], [1, 2, 8], [1, 7, 8]]


def test_holes_are_tried_again_from_their_next_half_edges(spark):
    m = MeshFrame.from_arrays(spark, QUAD[0], [[1, 2, 0], [0, 2, 3]])
    both = m.union(MeshFrame.from_arrays(spark, *BOX, mesh_id=1))
    assert {r["mesh_id"]: (r["n_faces"], r["n_boundary_edges"]) for r in repair.fill_holes(both).counts().collect()} == {0: (4, 0), 1: (7, 0)}
    # The fan from 2 -> 1 needs the diagonal that the mesh has, that from 1 -> 0 the other one.
    assert [repair.fill_hole(m, 0, h).faces.count() for h in (1, 5)] == [2, 4]


def test_fill_holes_query_inserts_its_caps(spark, monkeypatch):
    m = MeshFrame.from_arrays(spark, TETRA[0], TETRA[1][1:])
    monkeypatch.setattr(registry, "mesh", lambda *of: m)
    labels = made(monkeypatch, repair)
    assert [r.asDict() for r in registry.queries()["fill_holes"](spark, "").collect()] == [{"mesh_id": 0, "n_faces": 3, "n_caps": 1}]
    assert "told-faces" in labels
