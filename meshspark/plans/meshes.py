"""Meshes derived from the star-schema tables, in Spark and, word for word the same, in SQL.

grid: height fields over orders, GRID wide, all in mesh 0.  many: SMALL vertices a mesh, 10 wide.  checker: every other
cell of ``many``.  soup: ``many`` with three own vertices per triangle, some turned, doubled or degenerate, and a stray
vertex.  quads: ``many`` with one quad per cell.  holed: ``many`` without the triangle over every 20th vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.functions.shared import staged
from meshspark.operators.frame import MeshFrame

GRID, SMALL, WIDTH = 100, 150, 10
LARGE = 10**15
HEIGHT = 1.4142135e-5


def _points(spark: SparkSession, sf_dir: str, size: int, width: int) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(f"o_orderkey div {size}").alias("mesh_id"), (F.col("o_orderkey") % size).alias("v"), (F.col("o_totalprice") * HEIGHT).alias("z"))
    return o.select("mesh_id", "v", (F.col("v") % width).cast("double").alias("x"), F.expr(f"cast(v div {width} as double)").alias("y"), "z")


def _cells(points: DataFrame, width: int) -> DataFrame:
    top = points.groupBy("mesh_id").agg(F.max("v").alias("top"))
    return points.join(top, "mesh_id").where((F.col("v") % width < width - 1) & (F.col("v") + width + 1 <= F.col("top"))).select("mesh_id", F.col("v").alias("a"))


def _triangles(cells: DataFrame, width: int) -> DataFrame:
    a = F.col("a")
    two = F.array(F.struct((a * 2).alias("f"), F.array(a, a + 1, a + width + 1).alias("verts")), F.struct((a * 2 + 1).alias("f"), F.array(a, a + width + 1, a + width).alias("verts")))
    return cells.select("mesh_id", "a", F.inline(two))


def mesh(spark: SparkSession, sf_dir: str, kind: str) -> MeshFrame:
    """A mesh of some kind; what takes joins to derive is staged, as operators read a mesh's tables many times."""
    size, width = (LARGE, GRID) if kind == "grid" else (SMALL, WIDTH)
    p = _points(spark, sf_dir, size, width)
    cells = _cells(p, width)
    if kind == "checker":
        cells = cells.where(f"(a % {width} + a div {width}) % 2 = 0")
    if kind == "quads":
        a = F.col("a")
        return MeshFrame(p, staged(cells.select("mesh_id", a.alias("f"), F.array(a, a + 1, a + width + 1, a + width).alias("verts")), "mesh-faces"))
    t = _triangles(cells, width)
    if kind == "holed":
        t = t.where("not (a % 20 = 3 and f % 2 = 0)")
    t = t.select("mesh_id", "f", "verts")
    t = staged(t, "mesh-faces")
    if kind != "soup":
        return MeshFrame(p, t)
    v = t.select("mesh_id", "f", F.posexplode("verts").alias("k", "v")).join(p, ["mesh_id", "v"]).select("mesh_id", (F.col("f") * 3 + F.col("k")).alias("v"), "x", "y", "z")
    stray = t.select("mesh_id").distinct().select("mesh_id", F.lit(999999).cast("bigint").alias("v"), *[F.lit(-5.0).alias(c) for c in "xyz"])
    f = F.col("f") * 3
    own = F.when(F.col("f") % 3 == 0, F.array(f, f + 2, f + 1)).otherwise(F.array(f, f + 1, f + 2))
    base = t.select("mesh_id", (F.col("f") * 4).alias("f"), own.alias("verts"))
    twice = t.where("f % 17 = 0").select("mesh_id", (F.col("f") * 4 + 1).alias("f"), F.array(f + 1, f + 2, f).alias("verts"))
    flat = t.where("f % 23 = 0").select("mesh_id", (F.col("f") * 4 + 2).alias("f"), F.array(f, f, f + 1).alias("verts"))
    return MeshFrame(staged(v.unionByName(stray), "mesh-vertices"), base.unionByName(twice).unionByName(flat))


def sql(kind: str, *more: str) -> str:
    """WITH clauses of vertices, faces, corners, radial and edges of a mesh, and of ``more``."""
    size, width = (LARGE, GRID) if kind == "grid" else (SMALL, WIDTH)
    keep = {"checker": f"where (a % {width} + a // {width}) % 2 = 0", "holed": ""}.get(kind, "")
    base = f"""with recursive p as materialized (select o_orderkey // {size} as mesh_id, o_orderkey % {size} as v, (o_orderkey % {size} % {width})::double as x, (o_orderkey % {size} // {width})::double as y, o_totalprice * {HEIGHT!r} as z from orders),
cells as (select * from (select mesh_id, v as a from p join (select mesh_id, max(v) as top from p group by mesh_id) using (mesh_id) where v % {width} < {width - 1} and v + {width + 1} <= top) {keep}),
tri as (select mesh_id, a, 2 * a as f, [a, a + 1, a + {width + 1}] as verts from cells union all select mesh_id, a, 2 * a + 1, [a, a + {width + 1}, a + {width}] from cells),
"""
    if kind == "quads":
        base += f"faces as materialized (select mesh_id, a as f, [a, a + 1, a + {width + 1}, a + {width}] as verts from cells),\nvertices as materialized (select * from p)"
    elif kind == "soup":
        base += """faces as materialized (select mesh_id, 4 * f as f, case when f % 3 = 0 then [3 * f, 3 * f + 2, 3 * f + 1] else [3 * f, 3 * f + 1, 3 * f + 2] end as verts from tri
union all select mesh_id, 4 * f + 1, [3 * f + 1, 3 * f + 2, 3 * f] from tri where f % 17 = 0 union all select mesh_id, 4 * f + 2, [3 * f, 3 * f, 3 * f + 1] from tri where f % 23 = 0),
vertices as materialized (select t.mesh_id, 3 * t.f + k as v, x, y, z from (select *, unnest([0, 1, 2]) as k from tri) t join p on p.mesh_id = t.mesh_id and p.v = t.verts[k + 1] union all select distinct mesh_id, 999999, -5.0, -5.0, -5.0 from tri)"""
    else:
        gone = "where not (a % 20 = 3 and f % 2 = 0)" if kind == "holed" else ""
        base += f"faces as materialized (select mesh_id, f, verts from tri {gone}),\nvertices as materialized (select * from p)"
    base += """,
corners as materialized (select mesh_id, f, slot, len(verts) as n, verts[(slot + n - 1) % n + 1] as prev_v, verts[slot + 1] as v, verts[(slot + 1) % n + 1] as next_v, verts[(slot + 2) % n + 1] as after_v from (select *, unnest(range(len(verts))) as slot, len(verts) as n from faces)),
radial as materialized (select mesh_id, least(v, next_v) as lo, greatest(v, next_v) as hi, count(*) as n_faces, min(f * 16 + slot) as first, arg_min(v, f * 16 + slot) as v0, arg_min(next_v, f * 16 + slot) as v1, min(f) as f0, case when count(*) > 1 then max(f) end as f1 from corners group by 1, 2, 3),
edges as materialized (select *, row_number() over (partition by mesh_id order by first) - 1 as e, n_faces < 2 as is_boundary from radial)"""
    return ",\n".join([base, *more])
