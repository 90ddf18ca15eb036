"""Registered queries over the mesh operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.functions.shared import shared_dir
from meshspark.operators import check, decimate, edit, geometry, repair, smooth, subdivide
from meshspark.operators.frame import MeshFrame, change_status, test_status
from meshspark.operators.walk import Tables, Walk
from meshspark.operators.weld import exact, leaders
from meshspark.sources import files

from .meshes import mesh, sql

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, kind: str, text: str | None = None, *more: str):
    """Registers a function of a mesh of some kind; ``text`` selects the same rows in SQL."""

    def add(of: Callable[[MeshFrame], DataFrame]):
        _queries[name] = lambda spark, sf_dir: of(mesh(spark, sf_dir, kind))
        if text:
            _oracles[name] = sql(kind, *more) + "\n" + text
        return of

    return add


def _r(x: Column | str, name: str) -> Column:
    return (F.round(x, 6) + 0.0).alias(name)


def _xyz(v: str, prefix: str = "") -> list[Column]:
    return [_r(F.col(f"{v}.{c}"), f"{prefix}{c}") for c in "xyz"]


def _at(t: str, v: str) -> str:
    """One key of a mesh and a vertex, for DuckDB's joins."""
    return f"{t}.mesh_id * 1000000000 + {t}.{v}"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def rxyz(p: str = "", prefix: str = "", of: str = "{}") -> str:
    return ", ".join(f"{r(of.format(p + c))} as {prefix}{c}" for c in "xyz")


# Shared SQL.
HE = "h as (select mesh_id, 2 * e as h, v0 as src, v1 as dst from edges union all select mesh_id, 2 * e + 1, v1, v0 from edges), he as (select h.*, c.f, c.slot, c.after_v, c.prev_v from h left join corners c on c.mesh_id = h.mesh_id and c.v = h.src and c.next_v = h.dst)"
NB = "nb as (select mesh_id, lo as v, hi as w, n_faces from radial union all select mesh_id, hi, lo, n_faces from radial)"
OPEN = "opened as (select mesh_id, v, coalesce(bool_or(n_faces < 2), true) as open from vertices left join nb using (mesh_id, v) group by mesh_id, v)"
NORMAL = """cp as (select c.*, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz from corners c join vertices a on a.mesh_id * 1000000000 + a.v = c.mesh_id * 1000000000 + c.v join vertices b on b.mesh_id * 1000000000 + b.v = c.mesh_id * 1000000000 + c.next_v),
area as (select mesh_id, f, sum(ay * bz - az * by_) as nx, sum(az * bx - ax * bz) as ny, sum(ax * by_ - ay * bx) as nz, avg(ax) as cx, avg(ay) as cy, avg(az) as cz from cp group by 1, 2),
normal as (select mesh_id, f, sqrt(nx * nx + ny * ny + nz * nz) / 2 as area, nx / sqrt(nx * nx + ny * ny + nz * nz) as x, ny / sqrt(nx * nx + ny * ny + nz * nz) as y, nz / sqrt(nx * nx + ny * ny + nz * nz) as z, cx, cy, cz from area)"""
ENDS = "ends as (select e.*, a.x as ax, a.y as ay, a.z as az, b.x as ux, b.y as uy, b.z as uz from edges e join vertices a on a.mesh_id * 1000000000 + a.v = e.mesh_id * 1000000000 + e.v0 join vertices b on b.mesh_id * 1000000000 + b.v = e.mesh_id * 1000000000 + e.v1)"
SIDED = "sided as (select e.*, c.after_v as vc, d.after_v as vd, pc.x as cx, pc.y as cy, pc.z as cz, pd.x as dx, pd.y as dy, pd.z as dz from ends e left join corners c on c.mesh_id = e.mesh_id and c.v = e.v0 and c.next_v = e.v1 left join corners d on d.mesh_id = e.mesh_id and d.v = e.v1 and d.next_v = e.v0 left join vertices pc on pc.mesh_id * 1000000000 + pc.v = e.mesh_id * 1000000000 + c.after_v left join vertices pd on pd.mesh_id * 1000000000 + pd.v = e.mesh_id * 1000000000 + d.after_v)"
RING = "ring as (select nb.mesh_id, nb.v, count(*) as n, avg(q.x) as x, avg(q.y) as y, avg(q.z) as z, count(*) filter (n_faces < 2) as k, avg(q.x) filter (n_faces < 2) as ox, avg(q.y) filter (n_faces < 2) as oy, avg(q.z) filter (n_faces < 2) as oz from nb join vertices q on q.mesh_id * 1000000000 + q.v = nb.mesh_id * 1000000000 + nb.w group by 1, 2)"
WELD = "same as (select *, min(v) over (partition by mesh_id, x, y, z) as leader from vertices), wf as (select mesh_id, f, slot, s.leader as v from corners c join same s using (mesh_id, v)), wfaces as (select mesh_id, f, list(v order by slot) as verts from wf group by 1, 2)"
CC = "cc as (select mesh_id, v, v as w from vertices union select cc.mesh_id, cc.v, nb.w from cc join nb on nb.mesh_id = cc.mesh_id and nb.v = cc.w)"


# -- counts, tables, navigation --------------------------------------------------------------------------------

SUMMARY = """, x as (select mesh_id, count(*) as n_vertices from vertices group by 1), y as (select mesh_id, count(*) as n_edges, count(*) filter (n_faces < 2) as n_boundary_edges from radial group by 1), z as (select mesh_id, count(*) as n_faces from faces group by 1)"""


@query("mesh_counts_euler", "many", SUMMARY + " select mesh_id, n_vertices, n_edges, n_faces, n_boundary_edges, n_vertices - n_edges + n_faces as euler from x join y using (mesh_id) join z using (mesh_id)")
def _(m: MeshFrame) -> DataFrame:
    return m.counts()


@query("mesh_summary", "grid", f", {NORMAL}" + SUMMARY + f", a as (select mesh_id, {r('sum(area)')} as surface_area from normal group by 1) select mesh_id, n_vertices, n_edges, n_faces, n_boundary_edges, n_vertices - n_edges + n_faces as euler, surface_area from x join y using (mesh_id) join z using (mesh_id) join a using (mesh_id)")
def _(m: MeshFrame) -> DataFrame:
    area = geometry.face_measures(m).groupBy("mesh_id").agg(_r(F.sum("area"), "surface_area"))
    return m.counts().join(area, "mesh_id")


@query("edge_table", "grid", "select mesh_id, e, v0, v1, f0, coalesce(f1, -1) as f1, n_faces, is_boundary from edges")
def _(m: MeshFrame) -> DataFrame:
    return m.edges.select("mesh_id", "e", "v0", "v1", "f0", F.coalesce("f1", F.lit(-1)).alias("f1"), "n_faces", "is_boundary")


@query("halfedge_nav_next_prev", "grid", f"""select he.mesh_id, he.h, xor(he.h, 1) as opposite, he.h // 2 as e, he.src, he.dst, coalesce(he.f, -1) as f, case when he.f is null then bn.h else n.h end as next_h, case when he.f is null then bp.h else p.h end as prev_h from he
left join h n on {_at('n', 'src')} = {_at('he', 'dst')} and n.dst = he.after_v left join h p on {_at('p', 'src')} = {_at('he', 'prev_v')} and p.dst = he.src
left join rim bn on {_at('bn', 'src')} = {_at('he', 'dst')} left join rim bp on {_at('bp', 'dst')} = {_at('he', 'src')}""", HE, "rim as (select * from he where f is null)")
def _(m: MeshFrame) -> DataFrame:
    return m.halfedges.select("mesh_id", "h", F.col("h").bitwiseXOR(1).alias("opposite"), "e", "src", "dst", F.coalesce("f", F.lit(-1)).alias("f"), "next_h", "prev_h")


@query("find_halfedge_lookup", "grid", ", ask as (select mesh_id, v as a, v + 1 as b from vertices) select ask.mesh_id, a, b, coalesce(h.h, -1) as h from ask left join h on h.mesh_id = ask.mesh_id and h.src = a and h.dst = b", HE)
def _(m: MeshFrame) -> DataFrame:
    return m.find_halfedge(m.vertices.select("mesh_id", F.col("v").alias("a"), (F.col("v") + 1).alias("b"))).na.fill(-1, ["h"])


@query("stored_halfedges", "grid", "select mesh_id, src as v, arg_min(h, h + case when f is null then 0 else 1000000000000 end) as h from he group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return m.outgoing()


@query("face_halfedge", "grid", "select mesh_id, f, arg_max(h, slot) as h from he where f is not null group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return m.face_halfedge()


@query("boundary_vertices", "many", "select mesh_id, v from opened where open", NB, OPEN)
def _(m: MeshFrame) -> DataFrame:
    return m.boundary_vertices()


@query("boundary_faces", "many", "select distinct mesh_id, f0 as f from radial where n_faces = 1")
def _(m: MeshFrame) -> DataFrame:
    return m.boundary_faces()


@query("boundary_edges", "many", "select mesh_id, lo, hi from radial where n_faces = 1")
def _(m: MeshFrame) -> DataFrame:
    return m.radial.where("n_faces = 1").select("mesh_id", "lo", "hi")


@query("isolated_vertices", "soup", "select mesh_id, v from vertices anti join corners using (mesh_id, v)")
def _(m: MeshFrame) -> DataFrame:
    return m.isolated_vertices()


@query("vertex_valence", "grid", "select mesh_id, v, count(*) as valence from nb group by 1, 2", NB)
def _(m: MeshFrame) -> DataFrame:
    return m.valence()


def _listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))


@query("one_ring_sorted", "grid", "select mesh_id, v, string_agg(w, ',' order by w) as ring from nb group by 1, 2", NB)
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.one_ring(), "ring")


@query("ordered_ring", "many", f""", st as (select mesh_id, v, coalesce(min(prev_v) filter (prev_v not in (select d.next_v from corners d where d.mesh_id = c.mesh_id and d.v = c.v)), min(prev_v)) as start from corners c group by 1, 2),
walk as (select mesh_id, v, start as cur, 0 as k from st union all select walk.mesh_id, walk.v, c.next_v, k + 1 from walk join corners c on {_at('c', 'v')} = {_at('walk', 'v')} and c.prev_v = walk.cur join st on {_at('st', 'v')} = {_at('walk', 'v')} where c.next_v <> st.start) select mesh_id, v, string_agg(cur, ',' order by k) as ring from walk group by 1, 2""")
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.ordered_ring(), "ring")


@query("vertex_faces", "grid", "select mesh_id, v, string_agg(f, ',' order by f) as faces from corners group by 1, 2")
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.vertex_faces(), "faces")


@query("vertex_edges", "grid", ", u as (select mesh_id, e, v0 as v from edges union all select mesh_id, e, v1 from edges) select mesh_id, v, string_agg(e, ',' order by e) as edges from u group by 1, 2")
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.vertex_edges(), "edges")


@query("vertex_outgoing_halfedges", "grid", "select mesh_id, src as v, string_agg(h, ',' order by h) as halfedges from h group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.vertex_halfedges(), "halfedges")


@query("vertex_incoming_halfedges", "grid", "select mesh_id, dst as v, string_agg(h, ',' order by h) as halfedges from h group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.vertex_halfedges(True), "halfedges")


@query("face_halfedges", "grid", "select mesh_id, f, string_agg(h, ',' order by (slot + 1) % 3) as halfedges from he where f is not null group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.face_halfedges(), "halfedges")


@query("face_edges", "grid", "select mesh_id, f, string_agg(h // 2, ',' order by (slot + 1) % 3) as edges from he where f is not null group by 1, 2", HE)
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.face_edges(), "edges")


@query("face_vertices", "quads", "select mesh_id, f, array_to_string(verts, ',') as verts from faces")
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.face_vertices(), "verts")


@query("face_adjacency", "grid", f"select c.mesh_id, c.f, d.f as g from corners c join corners d on {_at('d', 'v')} = {_at('c', 'next_v')} and d.next_v = c.v")
def _(m: MeshFrame) -> DataFrame:
    return m.face_faces()


# -- geometry --------------------------------------------------------------------------------------------------


@query("face_area_normal_centroid", "grid", f"select mesh_id, f, {r('area')} as area, {rxyz('', 'n_')}, {r('cx')} as c_x, {r('cy')} as c_y, {r('cz')} as c_z from normal", NORMAL)
def _(m: MeshFrame) -> DataFrame:
    return geometry.face_measures(m).select("mesh_id", "f", _r("area", "area"), *_xyz("normal", "n_"), *_xyz("centroid", "c_"))


@query("edge_length_midpoint", "grid", f"select mesh_id, e, {r('sqrt((ux-ax)**2 + (uy-ay)**2 + (uz-az)**2)')} as length, {', '.join(r(f'(a{c} + u{c}) / 2') + f' as m_{c}, ' + r(f'u{c} - a{c}') + f' as v_{c}' for c in 'xyz')} from ends", ENDS)
def _(m: MeshFrame) -> DataFrame:
    return geometry.edge_measures(m).select("mesh_id", "e", _r("length", "length"), *_xyz("midpoint", "m_"), *_xyz("vector", "v_"))


@query("vertex_normals", "grid", f", s as (select mesh_id, v, sum(x) as x, sum(y) as y, sum(z) as z from corners join normal using (mesh_id, f) group by 1, 2), t as (select mesh_id, v, coalesce(s.x, 0) as x, coalesce(s.y, 0) as y, coalesce(s.z, 0) as z, sqrt(s.x**2 + s.y**2 + s.z**2) as n from vertices left join s using (mesh_id, v)) select mesh_id, v, {', '.join(r(f'case when n > 1e-30 then {c} / n else {c} end') + f' as {c}' for c in 'xyz')} from t", NORMAL)
def _(m: MeshFrame) -> DataFrame:
    return geometry.vertex_normals(m).select("mesh_id", "v", *_xyz("normal"))


@query("dihedral_angles", "grid", f""", d as (select e.*, n0.x as px, n0.y as py, n0.z as pz, n1.x as qx, n1.y as qy, n1.z as qz from ends e
left join corners c on c.mesh_id = e.mesh_id and c.v = e.v0 and c.next_v = e.v1 left join corners d on d.mesh_id = e.mesh_id and d.v = e.v1 and d.next_v = e.v0 left join normal n0 on n0.mesh_id = e.mesh_id and n0.f = c.f left join normal n1 on n1.mesh_id = e.mesh_id and n1.f = d.f),
g as (select *, acos(greatest(-1.0, least(1.0, px * qx + py * qy + pz * qz))) as a, (py * qz - pz * qy) * (ux - ax) + (pz * qx - px * qz) * (uy - ay) + (px * qy - py * qx) * (uz - az) as t from d)
select mesh_id, e, {r('case when px is null or qx is null then 0.0 when t < 0 then -a else a end')} as angle from g""", NORMAL, ENDS)
def _(m: MeshFrame) -> DataFrame:
    return geometry.dihedral_angles(m).select("mesh_id", "e", _r("angle", "angle"))


@query("sector_angles", "grid", f""", s as (select c.mesh_id, f, slot, q.x - p.x as ax, q.y - p.y as ay, q.z - p.z as az, o.x - p.x as ux, o.y - p.y as uy, o.z - p.z as uz from corners c join vertices p on p.mesh_id * 1000000000 + p.v = c.mesh_id * 1000000000 + c.v join vertices q on q.mesh_id * 1000000000 + q.v = c.mesh_id * 1000000000 + c.next_v join vertices o on o.mesh_id * 1000000000 + o.v = c.mesh_id * 1000000000 + c.prev_v)
select mesh_id, f, slot::int as slot, {r('acos(greatest(-1.0, least(1.0, (ax * ux + ay * uy + az * uz) / sqrt(ax**2 + ay**2 + az**2) / sqrt(ux**2 + uy**2 + uz**2))))')} as angle from s""")
def _(m: MeshFrame) -> DataFrame:
    return geometry.sector_angles(m).select("mesh_id", "f", "slot", _r("angle", "angle"))


@query("mesh_measures", "many", f", a as (select mesh_id, {r('sum(area)')} as surface_area from normal group by 1), b as (select mesh_id, {', '.join(f'{r(f'{fn}({c})')} as {p}_{c}' for p, fn in (('c', 'avg'), ('lo', 'min'), ('hi', 'max')) for c in 'xyz')} from vertices group by 1) select * from a join b using (mesh_id)", NORMAL)
def _(m: MeshFrame) -> DataFrame:
    return geometry.mesh_measures(m).select("mesh_id", _r("surface_area", "surface_area"), *_xyz("center", "c_"), *_xyz("low", "lo_"), *_xyz("high", "hi_"))


@query("vector_algebra", "grid", f", t as (select mesh_id, v, x as ax, y as ay, z as az, z as ux, x as uy, y as uz from vertices) select mesh_id, v, {r('ax * ux + ay * uy + az * uz')} as dot, {r('ay * uz - az * uy')} as cx, {r('az * ux - ax * uz')} as cy, {r('ax * uy - ay * ux')} as cz, {r('sqrt(ax**2 + ay**2 + az**2)')} as norm, {r('2 * (ax + ux) - ax')} as sx from t")
def _(m: MeshFrame) -> DataFrame:
    a, b = V.point(), V.vec("z", "x", "y")
    c = V.cross(a, b)
    return m.vertices.select("mesh_id", "v", _r(V.dot(a, b), "dot"), *[_r(c[k], f"c{k}") for k in "xyz"], _r(V.norm(a), "norm"), _r(V.sub(V.scale(V.add(a, b), 2.0), a)["x"], "sx"))


# -- validation ------------------------------------------------------------------------------------------------


@query("components", "many", "select mesh_id, v, min(w) as component from cc group by 1, 2", NB, CC)
def _(m: MeshFrame) -> DataFrame:
    return check.vertex_components(m)


@query("boundary_loops", "holed", """, b as (select * from he where f is null), step as (select b.mesh_id, b.h, n.h as next_h from b join b n on n.mesh_id = b.mesh_id and n.src = b.dst),
walk as (select mesh_id, h, next_h as w from step union select walk.mesh_id, walk.h, step.next_h from walk join step on step.mesh_id = walk.mesh_id and step.h = walk.w), low as (select mesh_id, h, min(w) as loop from walk group by 1, 2) select mesh_id, loop, count(*) as n_edges from low group by 1, 2""", HE)
def _(m: MeshFrame) -> DataFrame:
    return check.boundary_loops(m)


@query("nonmanifold_vertices", "checker", ", b as (select c.mesh_id, c.next_v as v from corners c anti join corners d on d.mesh_id = c.mesh_id and d.v = c.next_v and d.next_v = c.v) select mesh_id, v from b group by 1, 2 having count(*) > 1")
def _(m: MeshFrame) -> DataFrame:
    return check.nonmanifold_vertices(m)


@query("radial_edges", "soup", "select mesh_id, least(a, b) as lo, greatest(a, b) as hi, count(*) as n_faces from (select mesh_id, f, verts[k] as a, verts[k % 3 + 1] as b from (select *, unnest([1, 2, 3]) as k from wfaces)) group by 1, 2, 3", WELD)
def _(m: MeshFrame) -> DataFrame:
    return repair.weld(m, 1e-10).radial.select("mesh_id", "lo", "hi", "n_faces")


@query("degenerate_faces", "soup", "select mesh_id, f from faces where len(list_distinct(verts)) < len(verts)")
def _(m: MeshFrame) -> DataFrame:
    return check.degenerate_faces(m)


@query("duplicate_faces", "soup", ", k as (select mesh_id, f, list_sort(verts) as key from faces), g as (select *, min(f) over (partition by mesh_id, key) as first from k) select mesh_id, first, f from g where f <> first")
def _(m: MeshFrame) -> DataFrame:
    return check.duplicate_faces(m)


@query("weld_exact", "soup", "select mesh_id, v, leader from same", WELD)
def _(m: MeshFrame) -> DataFrame:
    return exact(m)


@query("duplicate_vertices", "soup", "select mesh_id, leader, v from same where v <> leader", WELD)
def _(m: MeshFrame) -> DataFrame:
    return check.duplicate_vertices(m)


#: One vertex after the other: the leaders so far, and whom the vertex follows.
SCAN = """pts as (select mesh_id, v, x, y, z, row_number() over (partition by mesh_id order by v) as n from vertices),
scan as (select mesh_id, 0::bigint as n, -1::bigint as v, -1::bigint as leader, []::struct(w bigint, x double, y double, z double)[] as led from (select distinct mesh_id from vertices)
union all select mesh_id, n, v, coalesce(own, v), case when own is null then list_append(led, struct_pack(w := v::bigint, x := x, y := y, z := z)) else led end from (
select p.mesh_id, p.n, p.v, p.x, p.y, p.z, led, list_min(list_transform(list_filter(led, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) <= TOL * TOL), lambda q: struct_pack(a := floor(q.z / TOL) - floor(p.z / TOL), b := floor(q.y / TOL) - floor(p.y / TOL), c := floor(q.x / TOL) - floor(p.x / TOL), w := q.w))).w as own
from scan s join pts p on p.mesh_id = s.mesh_id and p.n = s.n + 1))"""


@query("weld_tolerant_leaders", "many", "select mesh_id, v, leader from scan where n > 0", SCAN.replace("TOL", "1.02"))
def _(m: MeshFrame) -> DataFrame:
    return leaders(m, 1.02)


@query("connectivity_errors", "many", "select mesh_id, e as h from edges where false")
def _(m: MeshFrame) -> DataFrame:
    return check.connectivity_errors(m)


@query("self_intersections", "many")
def _(m: MeshFrame) -> DataFrame:
    return check.self_intersections(MeshFrame(m.vertices.withColumn("x", F.abs(F.col("x") - 4.3)), m.faces))


REPORT = """, b as (select * from he where f is null), step as (select b.mesh_id, b.h, n.h as next_h from b join b n on n.mesh_id = b.mesh_id and n.src = b.dst),
walk as (select mesh_id, h, next_h as w from step union select walk.mesh_id, walk.h, step.next_h from walk join step on step.mesh_id = walk.mesh_id and step.h = walk.w), low as (select mesh_id, h, min(w) as loop from walk group by 1, 2), loops as (select mesh_id, count(distinct loop) as n_loops from low group by 1),
parts as (select mesh_id, count(distinct component) as n_components from (select mesh_id, v, min(w) as component from cc group by 1, 2) group by 1),
lone as (select mesh_id, count(*) as n from vertices anti join corners using (mesh_id, v) group by 1),
wide as (select mesh_id, count(*) filter (n_faces > 2) as n_edges3, count(*) filter (n_faces < 2) as n_open from radial group by 1),
flat as (select mesh_id, count(*) filter (len(list_distinct(verts)) < 3) as n from faces group by 1),
twin as (select mesh_id, count(*) - count(distinct (x, y, z)) as n from vertices group by 1), same_f as (select mesh_id, count(*) - count(distinct list_sort(verts)) as n from faces group by 1),
fans as (select mesh_id, count(*) as n from (select mesh_id, src from b group by 1, 2 having count(*) > 1) group by 1)
"""


@query("check_report", "holed", SUMMARY + REPORT + """ select mesh_id, n_vertices, n_edges, n_faces, n_boundary_edges, n_vertices - n_edges + n_faces as euler, n_components, n_loops, coalesce(lone.n, 0) as n_isolated, coalesce(fans.n, 0) as n_nonmanifold_vertices, n_edges3 as n_nonmanifold_edges, 0 as n_connectivity_errors, 0 as n_incoherent_edges, flat.n as n_degenerate, twin.n as n_duplicate_vertices, same_f.n as n_duplicate_faces,
(2 * n_components - (n_vertices - n_edges + n_faces) - n_loops) // 2 as genus, n_open = 0 as is_closed, true as is_oriented, coalesce(fans.n, 0) + n_edges3 + flat.n + twin.n + same_f.n = 0 as ok from x join y using (mesh_id) join z using (mesh_id) join parts using (mesh_id) join loops using (mesh_id) left join lone using (mesh_id) join wide using (mesh_id) join flat using (mesh_id) join twin using (mesh_id) join same_f using (mesh_id) left join fans using (mesh_id)""", HE, NB, CC)
def _(m: MeshFrame) -> DataFrame:
    return check.report(m)


@query("is_valid", "checker", ", b as (select c.mesh_id, c.next_v as v from corners c anti join corners d on d.mesh_id = c.mesh_id and d.v = c.next_v and d.next_v = c.v), bad as (select distinct mesh_id from (select mesh_id, v from b group by 1, 2 having count(*) > 1)) select distinct mesh_id, mesh_id not in (select mesh_id from bad) as valid from vertices")
def _(m: MeshFrame) -> DataFrame:
    return check.is_valid(m)


# -- repair ----------------------------------------------------------------------------------------------------


@query("drop_degenerate", "soup", "select mesh_id, f from faces where len(list_distinct(verts)) = len(verts)")
def _(m: MeshFrame) -> DataFrame:
    return repair.drop_degenerate(m, 0.0).faces.select("mesh_id", "f")


@query("drop_duplicate", "soup", "select mesh_id, min(f) as f from faces group by mesh_id, list_sort(verts)")
def _(m: MeshFrame) -> DataFrame:
    return repair.drop_duplicate(m).faces.select("mesh_id", "f")


@query("drop_unused", "soup", "select mesh_id, v from vertices semi join corners using (mesh_id, v)")
def _(m: MeshFrame) -> DataFrame:
    return repair.drop_unused(m).vertices.select("mesh_id", "v")


def _clean(m: MeshFrame) -> MeshFrame:
    return repair.drop_duplicate(repair.drop_degenerate(repair.weld(m, 1e-10)))


@query("reorient_flips", "soup", ", base as (select mesh_id, (f // 4) % 3 = 0 as turned, f from faces where f % 4 = 0), seed as (select mesh_id, arg_min(turned, f) as t from base group by 1) select mesh_id, f from base join seed using (mesh_id) where turned <> t")
def _(m: MeshFrame) -> DataFrame:
    return repair.flips(_clean(m))


@query("split_fans", "checker", f""", c0 as (select *, mesh_id || ':' || f || ':' || slot as id from corners), k as (select a.mesh_id, a.f, a.slot, b.f as g, b.slot as t from corners a join corners b on b.mesh_id = a.mesh_id and b.v = a.v and (b.next_v = a.prev_v or b.prev_v = a.next_v)),
w as (select mesh_id, f, slot, f as g, slot as t from corners union select w.mesh_id, w.f, w.slot, k.g, k.t from w join k on k.mesh_id = w.mesh_id and k.f = w.g and k.slot = w.t), heads as (select mesh_id, f, slot, min(g * 16 + t) as head from w group by 1, 2, 3), n as (select mesh_id, head, row_number() over (partition by mesh_id order by head) - 1 as w from (select distinct mesh_id, head from heads)) select mesh_id, f, slot::int as slot, w from heads join n using (mesh_id, head)""")
def _(m: MeshFrame) -> DataFrame:
    return repair.split_fans(m).faces.select("mesh_id", "f", F.posexplode("verts").alias("slot", "w"))


@query("face_components", "checker", ", k as (select distinct c.mesh_id, c.f, d.f as g from corners c join corners d on d.mesh_id = c.mesh_id and least(d.v, d.next_v) = least(c.v, c.next_v) and greatest(d.v, d.next_v) = greatest(c.v, c.next_v)), w as (select mesh_id, f, f as g from faces union select w.mesh_id, w.f, k.g from w join k on k.mesh_id = w.mesh_id and k.f = w.g) select mesh_id, f, min(g) as component from w group by 1, 2")
def _(m: MeshFrame) -> DataFrame:
    return check.face_components(m)


@query("drop_small_components", "many", ", c3 as (select * from corners where f % 3 > 0), k as (select distinct c.mesh_id, c.f, d.f as g from c3 c join c3 d on d.mesh_id = c.mesh_id and d.v = c.next_v and d.next_v = c.v), w as (select mesh_id, f, f as g from faces where f % 3 > 0 union select w.mesh_id, w.f, k.g from w join k on k.mesh_id = w.mesh_id and k.f = w.g) select mesh_id, f from w group by 1, 2 having count(*) >= 3")
def _(m: MeshFrame) -> DataFrame:
    return repair.drop_small_components(MeshFrame(m.vertices, m.faces.where("f % 3 > 0")), 3).faces.select("mesh_id", "f")


@query("accepted_faces", "checker", "select mesh_id, f, true as accepted from faces")
def _(m: MeshFrame) -> DataFrame:
    return repair.accepted(m)


def _refused(i: int) -> tuple[str, str]:
    """SQL: the corners at the start of side i, and whether they keep a triangle (a, b, c) out of a mesh with the corners ``st``."""
    v, w, p = ("abc"[(i + k) % 3] for k in (0, 1, 2))
    t = f"list_filter(st, lambda q: q.v = {v})"
    heads = f"len(list_filter(t{i}, lambda q: not list_contains(list_transform(t{i}, lambda o: o.w), q.p)))"
    end = f"list_reduce(list_prepend({w}::bigint, list_transform(t{i}, lambda q: q.v)), lambda cur, o: coalesce(list_filter(t{i}, lambda q: q.p = cur)[1].w, cur))"
    used = f"len(list_filter(t{i}, lambda q: q.p = {p} or q.w = {w})) > 0"
    closing = f"len(list_filter(t{i}, lambda q: q.p = {w})) > 0 and {end} = {p} and {heads} > 1"
    return f"{t} as t{i}", f"(len(t{i}) > 0 and {heads} = 0) or {used} or ({closing})"


#: Face by face: the corners (v, previous, next) of the accepted ones, and whether the face is one.
ACCEPT = f"""tried as (select mesh_id, f, verts, row_number() over (partition by mesh_id order by f) as n from wfaces),
turn as (select mesh_id, 0::bigint as n, -1::bigint as f, true as accepted, []::struct(v bigint, p bigint, w bigint)[] as st from (select distinct mesh_id from wfaces)
union all select mesh_id, n, f, ok, case when ok then st || [struct_pack(v := a::bigint, p := c::bigint, w := b::bigint), struct_pack(v := b::bigint, p := a::bigint, w := c::bigint), struct_pack(v := c::bigint, p := b::bigint, w := a::bigint)] else st end from (
select *, a <> b and b <> c and a <> c and not ({" or ".join(f"({_refused(i)[1]})" for i in range(3))}) as ok from (select *, {", ".join(_refused(i)[0] for i in range(3))} from (select t.mesh_id, t.n, t.f, t.verts[1] as a, t.verts[2] as b, t.verts[3] as c, st from turn join tried t on t.mesh_id = turn.mesh_id and t.n = turn.n + 1))))"""


@query("accepted_soup_faces", "soup", "select mesh_id, f, accepted from turn where n > 0", WELD, ACCEPT)
def _(m: MeshFrame) -> DataFrame:
    return repair.accepted(repair.weld(m, 1e-10))


@query("repair_report", "soup", """, base as (select mesh_id, (f // 4) % 3 = 0 as turned, f from faces where f % 4 = 0), seed as (select mesh_id, arg_min(turned, f) as t from base group by 1), flip as (select mesh_id, count(*) as n from base join seed using (mesh_id) where turned <> t group by 1)
select mesh_id, (select count(*) from same where same.mesh_id = m.mesh_id and v <> leader) as vertices_merged, (select count(*) from wfaces w where w.mesh_id = m.mesh_id and len(list_distinct(verts)) < 3) as degenerate_removed, (select count(*) - count(distinct list_sort(verts)) from wfaces w where w.mesh_id = m.mesh_id and len(list_distinct(verts)) = 3) as duplicate_removed,
0 as nonmanifold_edges, coalesce(flip.n, 0) as faces_flipped, 0 as vertices_split, true as changed, 0 as faces_split, 0 as faces_failed from (select distinct mesh_id from vertices) m left join flip using (mesh_id)""", WELD)
def _(m: MeshFrame) -> DataFrame:
    return repair.load_and_repair(m)[1]


@query("repaired_mesh", "soup", ", q as (select mesh_id, count(*) as n_faces from tri group by 1), u as (select mesh_id, count(distinct v) as n_vertices from (select mesh_id, unnest(verts) as v from tri) group by 1) select mesh_id, n_vertices, n_faces from q join u using (mesh_id)")
def _(m: MeshFrame) -> DataFrame:
    return repair.load_and_repair(m)[0].counts().select("mesh_id", "n_vertices", "n_faces")


@query("fill_holes", "holed", "select mesh_id, count(*) as n_faces, (select count(*) from cells c where c.mesh_id = f.mesh_id and a % 20 = 3 and a > 10 and a % 10 < 8) as n_caps from faces f group by 1", "dummy as (select 1)")
def _(m: MeshFrame) -> DataFrame:
    filled = repair.fill_holes(m, 3).faces.groupBy("mesh_id").agg(F.count("*").alias("n_filled"))
    rows = m.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces")).join(filled, "mesh_id")
    return rows.select("mesh_id", "n_faces", (F.col("n_filled") - F.col("n_faces")).alias("n_caps"))


# -- deletion, editing -----------------------------------------------------------------------------------------


@query("delete_faces_compact", "grid", """, keep as (select * from faces where f % 5 <> 0), used as (select distinct mesh_id, unnest(verts) as v from keep), lost as (select distinct mesh_id, v from (select mesh_id, unnest(verts) as v from faces where f % 5 = 0) anti join used using (mesh_id, v)),
nv as (select mesh_id, v, row_number() over (partition by mesh_id order by v) - 1 as w from vertices anti join lost using (mesh_id, v)), nf as (select mesh_id, f, row_number() over (partition by mesh_id order by f) - 1 as g from keep)
select c.mesh_id, nf.g as f, string_agg(nv.w, ',' order by slot) as verts from corners c join nf on nf.mesh_id = c.mesh_id and nf.f = c.f join nv on nv.mesh_id = c.mesh_id and nv.v = c.v group by 1, 2""")
def _(m: MeshFrame) -> DataFrame:
    return _listed(m.delete_faces(m.faces.where("f % 5 = 0")).compacted().faces, "verts")


@query("delete_vertices", "many", "select mesh_id, f from faces anti join (select distinct mesh_id, f from corners where v % 11 = 0) using (mesh_id, f)")
def _(m: MeshFrame) -> DataFrame:
    return m.delete_vertices(m.vertices.where("v % 11 = 0")).faces.select("mesh_id", "f")


@query("delete_edges", "many", ", gone as (select distinct c.mesh_id, c.f from corners c where least(v, next_v) % 7 = 0 and greatest(v, next_v) = least(v, next_v) + 1) select mesh_id, f from faces anti join gone using (mesh_id, f)")
def _(m: MeshFrame) -> DataFrame:
    return m.delete_edges(m.radial.where("lo % 7 = 0 and hi = lo + 1")).faces.select("mesh_id", "f")


@query("triangulate_quads", "quads", ", t as (select mesh_id, f, k, verts[1] || ',' || verts[k + 1] || ',' || verts[k + 2] as verts from (select *, unnest([1, 2]) as k from faces)) select mesh_id, row_number() over (partition by mesh_id order by f, k) - 1 as f, verts from t")
def _(m: MeshFrame) -> DataFrame:
    return _listed(edit.triangulated(m).faces, "verts")


@query("flip_ok", "grid", "select s.mesh_id, s.e, coalesce(vc is not null and vd is not null and vc <> vd and t.lo is null, false) as ok from sided s left join radial t on t.mesh_id = s.mesh_id and t.lo = least(vc, vd) and t.hi = greatest(vc, vd)", ENDS, SIDED)
def _(m: MeshFrame) -> DataFrame:
    return edit.flip_candidates(m)


@query("flip_diagonals", "grid", ", w as (select *, f0 % 8 = 0 and v0 = least(v0, v1) + 101 as x from edges) select mesh_id, f, array_to_string(case when (f // 2) % 4 = 0 then case when f % 2 = 0 then [verts[2], verts[3], verts[3] - 1] else [verts[3], verts[1], verts[1] + 1] end else verts end, ',') as verts from faces")
def _(m: MeshFrame) -> DataFrame:
    e = m.edges.where("n_faces = 2 and f1 = f0 + 1 and f0 % 8 = 0 and f0 % 2 = 0").select("mesh_id", "e")
    return _listed(_rolled(edit.flip_edges(m, e)).faces, "verts")


def _rolled(m: MeshFrame) -> MeshFrame:
    """Triangles of a flipped diagonal turned so that they start at their first or last grid corner."""
    v = F.col("verts")
    even = F.array(F.array_max(v) - 100, F.array_max(v), F.array_max(v) - 1)
    odd = F.array(F.array_min(v) + 100, F.array_min(v), F.array_min(v) + 1)
    return MeshFrame(m.vertices, m.faces.withColumn("verts", F.when(F.expr("(f div 2) % 4 <> 0"), v).when(F.expr("f % 2 = 0"), even).otherwise(odd)))


@query("collapse_ok", "many", f""", s as (select a.mesh_id, a.v as src, a.w as dst, c.prev_v as l, d.prev_v as rr from nb a left join corners c on c.mesh_id = a.mesh_id and c.v = a.v and c.next_v = a.w left join corners d on d.mesh_id = a.mesh_id and d.v = a.w and d.next_v = a.v),
common as (select a.mesh_id, a.v as src, b.v as dst, count(*) as k from nb a join nb b on b.mesh_id = a.mesh_id and b.w = a.w group by 1, 2, 3),
wing as (select s.*, coalesce(k, 0) as k, coalesce((select bool_and(n_faces < 2) from nb where nb.mesh_id = s.mesh_id and nb.v = l and nb.w in (src, dst)), false) as lw, coalesce((select bool_and(n_faces < 2) from nb where nb.mesh_id = s.mesh_id and nb.v = rr and nb.w in (src, dst)), false) as rw from s left join common using (mesh_id, src, dst))
select w.mesh_id, src, dst, k = (l is not null)::int + (rr is not null)::int and not lw and not rw and not (l is not null and rr is not null and a.open and b.open) as ok from wing w join opened a on a.mesh_id = w.mesh_id and a.v = src join opened b on b.mesh_id = w.mesh_id and b.v = dst""", NB, OPEN)
def _(m: MeshFrame) -> DataFrame:
    return edit.collapse_candidates(m)


@query("face_split_all", "many", ", t as (select mesh_id, max(v) + 1 as top from vertices group by 1), n as (select *, row_number() over (partition by mesh_id order by f) - 1 as k from faces), x as (select n.mesh_id, top + k as w, verts, unnest([0, 1, 2]) as i from n join t using (mesh_id)) select mesh_id, verts[i + 1] || ',' || verts[(i + 1) % 3 + 1] || ',' || w as verts from x")
def _(m: MeshFrame) -> DataFrame:
    return _listed(edit.split_faces(m, m.faces).faces, "verts").select("mesh_id", "verts")


@query("edge_split", "many", SUMMARY + ", d as (select mesh_id, count(*) as k from edges where n_faces = 2 and f1 = f0 + 1 and f0 % 2 = 0 group by 1) select mesh_id, n_vertices + k as n_vertices, n_edges + 3 * k as n_edges, n_faces + 2 * k as n_faces, n_boundary_edges, n_vertices - n_edges + n_faces as euler from x join y using (mesh_id) join z using (mesh_id) join d using (mesh_id)")
def _(m: MeshFrame) -> DataFrame:
    e = m.edges.where("n_faces = 2 and f1 = f0 + 1 and f0 % 2 = 0").select("mesh_id", "e")
    return edit.split_edges(m, e).counts()


# -- subdivision, smoothing ------------------------------------------------------------------------------------

TOPS = "tops as (select mesh_id, max(v) + 1 as top from vertices group by 1)"


def _points_of(rows: DataFrame) -> DataFrame:
    return rows.select("mesh_id", "v", *[_r(c, c) for c in "xyz"])


def _edge_rule(of: str) -> str:
    return ", ".join(f"{r(of.replace('%', c))} as {c}" for c in "xyz")


def _one_to_four(of: str, old: str = f"select mesh_id, v, {rxyz()} from vertices") -> str:
    return f"{old} union all select s.mesh_id, top + e, {_edge_rule(of)} from sided s join tops using (mesh_id)"


BETA = "(5.0 / 8 - (3.0 / 8 + cos(2 * pi() / n) / 4) ** 2)"
OLD = "from vertices p join opened o on o.mesh_id = p.mesh_id and o.v = p.v left join ring q on q.mesh_id = p.mesh_id and q.v = p.v"


def _old(inner: str, fixed: bool = False) -> str:
    kept = "p.%" if fixed else "case when k = 2 then 0.75 * p.% + 0.25 * q.o% else p.% end"
    return f"select p.mesh_id, p.v, {', '.join(r(f'case when open then {kept} else {inner} end'.replace('%', c)) + f' as {c}' for c in 'xyz')} {OLD}"


@query("loop_subdivide", "grid", _one_to_four("case when cx is null or dx is null then (a% + u%) / 2 else 0.375 * (a% + u%) + 0.125 * (c% + d%) end", _old(f"(1 - {BETA}) * p.% + {BETA} * q.%")), NB, OPEN, RING, ENDS, SIDED, TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(subdivide.loop_subdivide(m).vertices)


@query("midpoint_subdivide", "grid", _one_to_four("(a% + u%) / 2"), ENDS, SIDED, TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(subdivide.midpoint_subdivide(m).vertices)


@query("subdivided_faces", "many", """, id as (select mesh_id, lo, hi, top + e as w from edges join tops using (mesh_id)), s as (select c.mesh_id, c.f, list(c.v order by slot) as v, list(w order by slot) as w from corners c join id on id.mesh_id = c.mesh_id and id.lo = least(c.v, c.next_v) and id.hi = greatest(c.v, c.next_v) group by 1, 2)
select mesh_id, 4 * f as f, v[3] || ',' || w[3] || ',' || w[2] as verts from s union all select mesh_id, 4 * f + 1, w[3] || ',' || v[1] || ',' || w[1] from s union all select mesh_id, 4 * f + 2, w[2] || ',' || w[1] || ',' || v[2] from s union all select mesh_id, 4 * f + 3, w[3] || ',' || w[1] || ',' || w[2] from s""", TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _listed(subdivide.midpoint_subdivide(m).faces, "verts")


WINGS = "wings as (select s.*, " + ", ".join(f"p{i}.{c} as w{i}{c}" for i in range(4) for c in "xyz") + " from sided s " + " ".join(f"left join corners k{i} on k{i}.mesh_id = s.mesh_id and k{i}.v = s.{x} and k{i}.next_v = s.{y} left join vertices p{i} on p{i}.mesh_id * 1000000000 + p{i}.v = s.mesh_id * 1000000000 + k{i}.after_v" for i, (x, y) in enumerate((("vc", "v1"), ("v0", "vc"), ("vd", "v0"), ("v1", "vd")))) + ")"


@query("butterfly_subdivide", "grid", f"select mesh_id, v, {rxyz()} from vertices union all select s.mesh_id, top + e, {_edge_rule('case when cx is null or dx is null then (a% + u%) / 2 when w0x is null or w1x is null or w2x is null or w3x is null then (a% + u%) / 2 + (c% + d%) / 8 else (a% + u%) / 2 + (c% + d%) / 8 - (w0% + w1% + w2% + w3%) / 16 end')} from wings s join tops using (mesh_id)", ENDS, SIDED, WINGS, TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(subdivide.butterfly_subdivide(m).vertices)


CENTRES = "centres as (select c.mesh_id, c.f, avg(x) as x, avg(y) as y, avg(z) as z from corners c join vertices using (mesh_id, v) group by 1, 2)"


@query("catmull_clark", "quads", f""", fa as (select c.mesh_id, c.v, avg(x) as fx, avg(y) as fy, avg(z) as fz from corners c join centres using (mesh_id, f) group by 1, 2), tf as (select mesh_id, top, top + max(f) + 1 as top_f from tops join faces using (mesh_id) group by 1, 2)
{_old('(fa.f% + (p.% + q.%) + p.% * (n - 3)) / n')} left join fa on fa.mesh_id = p.mesh_id and fa.v = p.v union all select mesh_id, top + f, {rxyz()} from centres join tops using (mesh_id)
union all select e.mesh_id, top_f + e, {_edge_rule('case when is_boundary then (a% + u%) / 2 else (a% + u% + g.% + k.%) / 4 end')} from ends e join tf using (mesh_id) left join centres g on g.mesh_id = e.mesh_id and g.f = e.f0 left join centres k on k.mesh_id = e.mesh_id and k.f = e.f1""", NB, OPEN, RING, ENDS, CENTRES, TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(subdivide.catmull_clark(m).vertices)


A = "((4 - 2 * cos(2 * pi() / n)) / 9)"


@query("sqrt3_subdivide", "grid", f"{_old(f'(1 - {A}) * p.% + {A} * q.%', True)} union all select mesh_id, top + f, {rxyz()} from centres join tops using (mesh_id)", NB, OPEN, RING, CENTRES, TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(subdivide.sqrt3_subdivide(m).vertices)


@query("sqrt3_faces", "many", "select c.mesh_id, 3 * c.f + c.slot as f, case when d.f is null then c.v || ',' || c.next_v || ',' || (top + c.f) else (top + c.f) || ',' || c.v || ',' || (top + d.f) end as verts from corners c left join corners d on d.mesh_id * 1000000000 + d.v = c.mesh_id * 1000000000 + c.next_v and d.next_v = c.v join tops t on t.mesh_id = c.mesh_id", TOPS)
def _(m: MeshFrame) -> DataFrame:
    return _listed(subdivide.sqrt3_subdivide(m).faces, "verts")


@query("laplacian_1", "grid", _old("(p.% + q.%) / 2", True), NB, OPEN, RING)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(smooth.laplacian_smooth(m).vertices)


COTAN = """tri3 as (select c.mesh_id, c.v, c.next_v, p.x as px, p.y as py, p.z as pz, q.x as qx, q.y as qy, q.z as qz, p.x - o.x as ax, p.y - o.y as ay, p.z - o.z as az, q.x - o.x as ux, q.y - o.y as uy, q.z - o.z as uz from corners c join vertices p on p.mesh_id * 1000000000 + p.v = c.mesh_id * 1000000000 + c.v join vertices q on q.mesh_id * 1000000000 + q.v = c.mesh_id * 1000000000 + c.next_v join vertices o on o.mesh_id * 1000000000 + o.v = c.mesh_id * 1000000000 + c.after_v),
cot as (select *, (ax * ux + ay * uy + az * uz) / sqrt((ay * uz - az * uy)**2 + (az * ux - ax * uz)**2 + (ax * uy - ay * ux)**2) as w from tri3), cs as (select mesh_id, v, w, qx as x, qy as y, qz as z from cot union all select mesh_id, next_v, w, px, py, pz from cot),
cm as (select mesh_id, v, sum(w * x) / sum(w) as x, sum(w * y) / sum(w) as y, sum(w * z) / sum(w) as z from cs group by 1, 2 having abs(sum(w)) > 1e-20)"""


@query("cotan_1", "grid", f"select p.mesh_id, p.v, {', '.join(r(f'case when open or cm.x is null then p.{c} else (p.{c} + cm.{c}) / 2 end') + f' as {c}' for c in 'xyz')} from vertices p join opened o on o.mesh_id = p.mesh_id and o.v = p.v left join cm on cm.mesh_id = p.mesh_id and cm.v = p.v", NB, OPEN, COTAN)
def _(m: MeshFrame) -> DataFrame:
    return _points_of(smooth.cotan_smooth(m).vertices)


@query("longest_edge", "many")
def _(m: MeshFrame) -> DataFrame:
    return subdivide.longest_edge_subdivide(m, 1.2).counts()


# -- decimation ------------------------------------------------------------------------------------------------

QUADRICS = "plane as (select n.mesh_id, n.f, n.x as a, n.y as b, n.z as c, -(n.x * p.x + n.y * p.y + n.z * p.z) as d from normal n join corners k on k.mesh_id = n.mesh_id and k.f = n.f and k.slot = 0 join vertices p on p.mesh_id * 1000000000 + p.v = k.mesh_id * 1000000000 + k.v), quad as (select k.mesh_id, k.v, " + ", ".join(f"sum({n[0]} * {n[1]}) as {n}" for n in decimate.QUADRIC) + " from corners k join plane using (mesh_id, f) group by 1, 2)"


@query("vertex_quadrics", "many", f"select mesh_id, v, {', '.join(f'{r(n)} as {n}' for n in decimate.QUADRIC)} from quad", NORMAL, QUADRICS)
def _(m: MeshFrame) -> DataFrame:
    return decimate.vertex_quadrics(m).select("mesh_id", "v", *[_r(F.col(f"q.{n}"), n) for n in decimate.QUADRIC])


def _error(p: str) -> str:
    x, y, z = (p.replace("%", c) for c in "xyz")
    s = {n: f"(s.{n} + t.{n})" for n in decimate.QUADRIC}
    return f"({s['aa']} * {x} * {x} + {s['bb']} * {y} * {y} + {s['cc']} * {z} * {z} + 2 * ({s['ab']} * {x} * {y} + {s['ac']} * {x} * {z} + {s['bc']} * {y} * {z}) + 2 * ({s['ad']} * {x} + {s['bd']} * {y} + {s['cd']} * {z}) + {s['dd']})"


@query("collapse_costs", "many", f"select e.mesh_id, e.lo, e.hi, {r(f'least({_error("e.a%")}, {_error("e.u%")}, {_error("((e.a% + e.u%) / 2)")})')} as cost from ends e join quad s on s.mesh_id = e.mesh_id and s.v = e.lo join quad t on t.mesh_id = e.mesh_id and t.v = e.hi", NORMAL, QUADRICS, ENDS)
def _(m: MeshFrame) -> DataFrame:
    return decimate.collapse_costs(m).select("mesh_id", "lo", "hi", _r("cost", "cost"))


@query("decimate_quadric", "many")
def _(m: MeshFrame) -> DataFrame:
    return decimate.quadric_decimate(m, 128).counts()


@query("decimate_modules", "many")
def _(m: MeshFrame) -> DataFrame:
    d = decimate.Decimator(m).add_module(decimate.ModQuadric()).add_module(decimate.ModNormalFlipping(1.4)).add_module(decimate.ModAspectRatio(20.0)).add_module(decimate.ModEdgeLength(4.0))
    d.decimate_to_faces(160)
    return d.mesh.counts()


# -- properties, union -----------------------------------------------------------------------------------------


@query("property_defaults", "many", "select mesh_id, v, case when v % 2 = 0 then v::double else 1.5 end as heat, 7 as tag, 0.0 as nx from vertices")
def _(m: MeshFrame) -> DataFrame:
    m = m.with_property("vertex", "heat", "float", 1.5).with_property("vertex", "tag", "int", 7).with_property("vertex", "dir", "vec3", (0.0, 1.0, 2.0)).with_property("vertex", "gone", "int", 1).without_property("vertex", "gone")
    m = m.set_values("vertex", "heat", m.vertices.where("v % 2 = 0").select("mesh_id", "v", F.col("v").cast("double").alias("value")))
    return m.vertices.select("mesh_id", "v", "heat", "tag", F.col("dir.x").alias("nx"))


@query("status_bits", "many", "select mesh_id, v, (case when v % 2 = 0 then 1 else 0 end + case when v % 3 = 0 then 8 else 0 end)::int as status, v % 3 = 0 as feature, false as hidden from vertices")
def _(m: MeshFrame) -> DataFrame:
    v = change_status(m.vertices, "selected", F.col("v") % 2 == 0)
    v = change_status(change_status(v, "feature", F.col("v") % 3 == 0), "hidden", F.lit(False))
    return v.select("mesh_id", "v", "status", test_status(v, "feature").alias("feature"), test_status(v, "hidden").alias("hidden"))


@query("append_mesh", "many", ", t as (select mesh_id, max(v) + 1 as top from vertices group by 1) select mesh_id, v, x from vertices union all select mesh_id, v + top, x + 100 from vertices join t using (mesh_id)")
def _(m: MeshFrame) -> DataFrame:
    return m.union(MeshFrame(m.vertices.withColumn("x", F.col("x") + 100), m.faces)).vertices.select("mesh_id", "v", "x")


@query("set_points", "many", f"select mesh_id, v, x, y, case when v % 2 = 0 then {math.pi!r} else z end as z from vertices")
def _(m: MeshFrame) -> DataFrame:
    return m.with_points(m.vertices.where("v % 2 = 0").withColumn("z", F.lit(math.pi))).vertices


# -- bulk copies, walks, properties of edges -------------------------------------------------------------------


@query("triangle_table", "grid", "select mesh_id, f, verts[1] as a, verts[2] as b, verts[3] as c from faces")
def _(m: MeshFrame) -> DataFrame:
    return m.triangles()


@query("grown_properties", "many", ", t as (select mesh_id, max(v) + 1 as top from vertices group by 1) select mesh_id, v, v::double as heat, 2.0 as up from vertices union all select mesh_id, top, 1.5, 2.0 from t")
def _(m: MeshFrame) -> DataFrame:
    m = m.with_property("vertex", "heat", "float", 1.5).with_property("vertex", "dir", "vec3", (0.0, 1.0, 2.0))
    m = m.set_values("vertex", "heat", m.vertices.select("mesh_id", "v", F.col("v").cast("double").alias("value")))
    one = m.vertices.where("v = 0").select("mesh_id", F.lit(0).alias("k"), *"xyz")
    return m.add_vertices(one).vertices.select("mesh_id", "v", "heat", F.col("dir.z").alias("up"))


@query("edge_properties", "many", "select mesh_id, e, case when e % 3 = 0 then e::double else 0.25 end as weight, case when e % 4 = 0 then 8 else 0 end::int as status from edges")
def _(m: MeshFrame) -> DataFrame:
    m = m.with_property("edge", "weight", "float", 0.25)
    m = m.set_values("edge", "weight", m.edges.where("e % 3 = 0").select("mesh_id", "e", F.col("e").cast("double").alias("value")))
    return m.change_status("edge", "feature", m.edges.where("e % 4 = 0").select("mesh_id", "e", F.lit(True).alias("on"))).values("edge").select("mesh_id", "e", "weight", "status")


@query("halfedge_properties", "many", "select mesh_id, h, case when h % 5 = 0 then 7 else 3 end::int as tag from h", HE)
def _(m: MeshFrame) -> DataFrame:
    m = m.with_property("halfedge", "tag", "int", 3)
    return m.set_values("halfedge", "tag", m.halfedges.where("h % 5 = 0").select("mesh_id", "h", F.lit(7).alias("value"))).values("halfedge").select("mesh_id", "h", "tag")


@query("walk_halfedges", "many", f"select he.mesh_id, he.h as begin, n.dst as id from he join he n on {_at('n', 'src')} = {_at('he', 'dst')} and n.dst = he.after_v where he.f is not null", HE)
def _(m: MeshFrame) -> DataFrame:
    t = Tables(m)
    return Walk.over(t, "halfedge", t.halfedges.where("f is not null").select("mesh_id", "h")).keep("begin").next().to().rows


@query("walk_vertices", "many", f"select distinct v.mesh_id, v.v as begin, h.dst as id from vertices v join h on {_at('h', 'src')} = {_at('v', 'v')}", HE)
def _(m: MeshFrame) -> DataFrame:
    return Walk.over(m, "vertex", m.vertices.select("mesh_id", "v")).keep("begin").vertices().rows


@query("walk_edges", "many", "select mesh_id, e as begin, v0 as id from edges union all select mesh_id, e, v1 from edges")
def _(m: MeshFrame) -> DataFrame:
    w = Walk.over(m, "edge", m.edges.select("mesh_id", "e")).keep("begin")
    return w.v0().rows.unionByName(w.v1().rows)


@query("walk_faces", "many", f"select c.mesh_id, c.f as begin, d.f as id from corners c join corners d on {_at('d', 'v')} = {_at('c', 'next_v')} and d.next_v = c.v")
def _(m: MeshFrame) -> DataFrame:
    return Walk.over(m, "face", m.faces.select("mesh_id", "f")).keep("begin").faces().rows


@query("walk_boundary", "many", "select mesh_id, h as id, f is null as is_boundary from he", HE)
def _(m: MeshFrame) -> DataFrame:
    return Walk.over(m, "halfedge", m.half_ids.select("mesh_id", "h")).is_boundary()


@query("repair_mesh", "soup", ", q as (select mesh_id, count(distinct list_sort(verts)) as n_faces from wfaces where len(list_distinct(verts)) = 3 group by 1), u as (select mesh_id, count(distinct v) as n_vertices from (select mesh_id, unnest(verts) as v from tri) group by 1) select mesh_id, n_vertices, n_faces from q join u using (mesh_id)", WELD)
def _(m: MeshFrame) -> DataFrame:
    return repair.repair_mesh(m)[0].counts().select("mesh_id", "n_vertices", "n_faces")


# -- files -----------------------------------------------------------------------------------------------------


def _round_trip(kind: str, binary: bool):
    def of(m: MeshFrame) -> DataFrame:
        folder = f"{shared_dir(m.vertices.sparkSession)}/meshes-{uuid.uuid4().hex}"
        files.write(m, folder, kind, binary)
        return files.read(m.vertices.sparkSession, folder).counts().drop("mesh_id")

    return of


_TRIPS = ", q as (select mesh_id, count(*) as n_faces from faces group by 1), u as (select mesh_id, count(*) as n_vertices from vertices group by 1), w as (select mesh_id, count(*) as n_edges, count(*) filter (n_faces < 2) as n_boundary_edges from radial group by 1) select n_vertices, n_edges, n_faces, n_boundary_edges, n_vertices - n_edges + n_faces as euler from q join u using (mesh_id) join w using (mesh_id)"
for _kind, _binary in (("obj", False), ("off", False), ("ply", False), ("ply", True), ("stl", False), ("stl", True)):
    query(f"round_trip_{_kind}{'_binary' if _binary else ''}", "many", _TRIPS)(_round_trip(_kind, _binary))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
