"""MeshFrame: a collection of polygon meshes as two DataFrames.

vertices(mesh_id, v, x, y, z, ...) and faces(mesh_id, f, verts, ...) hold everything; corners, edges and half-edges
are derived.  Further columns are properties and stay with their rows; a property's default is kept in its column's
metadata and fills rows that are added later.  Properties of edges and half-edges are sparse tables by end vertices,
so that they outlive a new numbering: edge_values(mesh_id, lo, hi, ...), halfedge_values(mesh_id, src, dst, ...).
An optional boolean column ``deleted`` marks tombstones, an optional int column ``status`` holds flag bits.  All
operators are keyed by (mesh_id, id), so one huge mesh and many small ones are spread alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshspark.functions.numbering import numbered
from meshspark.functions.shared import dropped, staged

#: Status bits.
SELECTED, TAGGED, LOCKED, FEATURE, HIDDEN = 1, 2, 4, 8, 16
FLAGS = {"selected": SELECTED, "tagged": TAGGED, "locked": LOCKED, "feature": FEATURE, "hidden": HIDDEN}
VERTEX_SCHEMA = "mesh_id bigint, v bigint, x double, y double, z double"
FACE_SCHEMA = "mesh_id bigint, f bigint, verts array<bigint>"
PROPERTY_TYPES = {"float": "double", "int": "int", "vec3": "struct<x:double,y:double,z:double>"}
#: Key columns of the tables that hold the properties of an element, and columns that are not properties.
KEYS = {"vertex": ("mesh_id", "v"), "face": ("mesh_id", "f"), "edge": ("mesh_id", "lo", "hi"), "halfedge": ("mesh_id", "src", "dst")}
OWN = frozenset("mesh_id v x y z f verts lo hi src dst deleted status".split())


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in rows.columns else rows


def _default(rows: DataFrame, name: str) -> Column:
    """The default of a property column, or null."""
    field = rows.schema[name]
    value = field.metadata.get("default")
    value = F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("xyz", value, strict=True)]) if isinstance(value, list) else F.lit(value)
    return value.cast(field.dataType)


def _kept(rows: DataFrame, name: str, value: Column) -> Column:
    """``value`` as a column of that name with the metadata it has in ``rows``."""
    return value.alias(name, metadata=rows.schema[name].metadata)


def _grown(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` and ``new``, whose missing property columns get their defaults."""
    lacking = [c for c in rows.columns if c not in new.columns]
    return rows.unionByName(new.select("*", *[_default(rows, c).alias(c) for c in lacking]), True)


@dataclass(frozen=True)
class MeshFrame:
    vertices: DataFrame
    faces: DataFrame
    edge_values: DataFrame | None = None
    halfedge_values: DataFrame | None = None

    # -- construction ----------------------------------------------------------------------------------------

    @staticmethod
    def from_arrays(spark: SparkSession, points: Sequence, faces: Sequence, mesh_id: int = 0) -> MeshFrame:
        """A mesh from a list of points and a list of index lists."""
        v = spark.createDataFrame([(mesh_id, i, *map(float, p)) for i, p in enumerate(points)], VERTEX_SCHEMA)
        f = spark.createDataFrame([(mesh_id, i, [int(x) for x in w]) for i, w in enumerate(faces)], FACE_SCHEMA)
        return MeshFrame(v, f)

    @staticmethod
    def empty(spark: SparkSession) -> MeshFrame:
        return MeshFrame(spark.createDataFrame([], VERTEX_SCHEMA), spark.createDataFrame([], FACE_SCHEMA))

    def union(self, other: MeshFrame) -> MeshFrame:
        """Both collections; a mesh_id that both have becomes one mesh, the other's ids following this one's."""
        top_v = self.vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("__v"))
        top_f = self.faces.groupBy("mesh_id").agg((F.max("f") + 1).alias("__f"))
        off = top_v.join(top_f, "mesh_id", "left").select("mesh_id", "__v", F.coalesce("__f", F.lit(0)).alias("__f"))
        v = other.vertices.join(off, "mesh_id", "left").withColumn("v", F.col("v") + F.coalesce("__v", F.lit(0))).drop("__v", "__f")
        f = other.faces.join(off, "mesh_id", "left").withColumn("verts", F.transform("verts", lambda x: x + F.coalesce(F.col("__v"), F.lit(0))))
        f = f.withColumn("f", F.col("f") + F.coalesce("__f", F.lit(0))).drop("__v", "__f")
        return MeshFrame(_grown(self.vertices, v), _grown(self.faces, f))

    def add_vertices(self, rows: DataFrame) -> MeshFrame:
        """With rows (mesh_id, k, x, y, z): ids follow the mesh's largest, in the order of k."""
        top = self.vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("__v"))
        new = numbered(rows, "v", F.col("k")).join(top, "mesh_id", "left").withColumn("v", F.col("v") + F.coalesce("__v", F.lit(0)))
        return replace(self, vertices=_grown(self.vertices, new.drop("__v", "k")))

    def add_faces(self, rows: DataFrame) -> MeshFrame:
        """With rows (mesh_id, k, verts): ids follow the mesh's largest; repair.insert_faces takes manifold ones only."""
        top = self.faces.groupBy("mesh_id").agg((F.max("f") + 1).alias("__f"))
        new = numbered(rows, "f", F.col("k")).join(top, "mesh_id", "left").withColumn("f", F.col("f") + F.coalesce("__f", F.lit(0)))
        return replace(self, faces=_grown(self.faces, new.drop("__f", "k")))

    def positions(self) -> DataFrame:
        """mesh_id, v, x, y, z of all vertices: a copy of the positions."""
        return self.vertices.select("mesh_id", "v", *"xyz")

    def triangles(self) -> DataFrame:
        """mesh_id, f, a, b, c of all live faces; raises if one is not a triangle."""
        if not self.live_faces.where("size(verts) <> 3").isEmpty():
            raise ValueError("a face is not a triangle")
        return self.live_faces.select("mesh_id", "f", *[F.get("verts", F.lit(i)).alias(c) for i, c in enumerate("abc")])

    def to_numpy(self, mesh_id: int = 0) -> tuple:
        """(positions (n, 3), triangles (m, 3)) of one mesh, dense and in the order of ids; for a mesh that fits the driver."""
        one = replace(self, vertices=self.vertices.where(F.col("mesh_id") == mesh_id), faces=self.faces.where(F.col("mesh_id") == mesh_id)).compacted()
        v, t = one.positions().toPandas().sort_values("v"), one.triangles().toPandas().sort_values("f")
        return v[["x", "y", "z"]].to_numpy(), t[["a", "b", "c"]].to_numpy()

    def set_points(self, points: DataFrame) -> MeshFrame:
        """With the positions of rows (mesh_id, v, x, y, z), which must hold every vertex once."""
        both = self.vertices.select("mesh_id", "v").join(points.select("mesh_id", "v", F.lit(1).alias("n")), ["mesh_id", "v"], "full")
        if not both.groupBy("mesh_id", "v").agg(F.sum("n").alias("n")).join(self.vertices.select("mesh_id", "v", F.lit(True).alias("own")), ["mesh_id", "v"], "left").where("n is null or n > 1 or own is null").isEmpty():
            raise ValueError("the rows must be those of the vertices")
        return self.with_points(points)

    def with_points(self, points: DataFrame) -> MeshFrame:
        """With the positions of rows (mesh_id, v, x, y, z) in place of the old ones."""
        p = points.select("mesh_id", "v", *[F.col(c).alias(f"__{c}") for c in "xyz"])
        v = self.vertices.join(p, ["mesh_id", "v"], "left").withColumns({c: F.coalesce(f"__{c}", c) for c in "xyz"}).drop("__x", "__y", "__z")
        return replace(self, vertices=v.select(self.vertices.columns))

    def __repr__(self) -> str:
        return f"MeshFrame(vertices{self.vertices.columns}, faces{self.faces.columns})"

    # -- derived tables --------------------------------------------------------------------------------------

    @cached_property
    def live_vertices(self) -> DataFrame:
        return live(self.vertices)

    @cached_property
    def live_faces(self) -> DataFrame:
        return live(self.faces)

    @cached_property
    def corners(self) -> DataFrame:
        """(mesh_id, f, slot, n, prev_v, v, next_v, after_v): every side v -> next_v of every live face."""
        at = lambda k: F.get("verts", (F.col("slot") + k) % F.size("verts"))
        c = self.live_faces.select("mesh_id", "f", "verts", F.explode(F.sequence(F.lit(0), F.size("verts") - 1)).alias("slot"))
        return c.where(F.size("verts") > 0).select("mesh_id", "f", "slot", F.size("verts").alias("n"), at(F.size("verts") - 1).alias("prev_v"), at(F.lit(0)).alias("v"), at(F.lit(1)).alias("next_v"), at(F.lit(2)).alias("after_v"))

    @cached_property
    def radial(self) -> DataFrame:
        """(mesh_id, lo, hi, n_faces, first): undirected edges with their number of sides and first side."""
        side = F.struct("f", "slot", F.col("v").alias("v0"), F.col("next_v").alias("v1"))
        return self.corners.groupBy("mesh_id", F.least("v", "next_v").alias("lo"), F.greatest("v", "next_v").alias("hi")).agg(F.count("*").alias("n_faces"), F.min(side).alias("first"), F.max(side).alias("last"))

    @cached_property
    def edges(self) -> DataFrame:
        """(mesh_id, e, v0, v1, lo, hi, f0, f1, n_faces, is_boundary); e counts edges by their first side.

        Staged, as ``halfedges`` are: whatever joins them several times repeats a scan and not their whole plan, whose
        copies (broadcasts, generated code) add up in the driver.
        """
        e = numbered(self.radial, "e", F.col("first.f"), F.col("first.slot"))
        f1 = F.when(F.col("n_faces") > 1, F.col("last.f"))
        return staged(e.select("mesh_id", "e", "first.v0", "first.v1", "lo", "hi", F.col("first.f").alias("f0"), f1.alias("f1"), "n_faces", (F.col("n_faces") < 2).alias("is_boundary")), "edges")

    @cached_property
    def sides(self) -> DataFrame:
        """(mesh_id, src, dst, f, slot, n, prev_v, after_v): both directions of every edge; f is null outside."""
        c = self.corners.select("mesh_id", F.col("v").alias("src"), F.col("next_v").alias("dst"), "f", "slot", "n", "prev_v", "after_v")
        both = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
        return self.radial.select("mesh_id", F.inline(both)).join(c, ["mesh_id", "src", "dst"], "left")

    @cached_property
    def half_ids(self) -> DataFrame:
        """(mesh_id, h, e, src, dst): both directions of every edge, each once; h ^ 1 is the opposite."""
        ids = F.array(F.struct((F.col("e") * 2).alias("h"), "e", F.col("v0").alias("src"), F.col("v1").alias("dst")), F.struct((F.col("e") * 2 + 1).alias("h"), "e", F.col("v1").alias("src"), F.col("v0").alias("dst")))
        return self.edges.select("mesh_id", F.inline(ids))

    @cached_property
    def half_sides(self) -> DataFrame:
        """(mesh_id, h, e, src, dst, f, slot, n): half-edges with the side of n that they run along, null outside."""
        c = self.corners.select("mesh_id", F.col("v").alias("src"), F.col("next_v").alias("dst"), "f", "slot", "n")
        out = self.half_ids.join(c, ["mesh_id", "src", "dst"], "left")
        return staged(out.select("mesh_id", "h", "e", "src", "dst", "f", "slot", "n"), "half-sides")

    def open_halfedges(self) -> DataFrame:
        """(mesh_id, h, e, src, dst, next_h, prev_h) outside of all faces; unique where at most one boundary passes a vertex."""
        o = self.half_sides.where("f is null").select("mesh_id", "h", "e", "src", "dst")
        n = o.groupBy("mesh_id", F.col("src").alias("dst")).agg(F.min(F.struct("dst", "h")).alias("n"))
        p = o.groupBy("mesh_id", F.col("dst").alias("src")).agg(F.min(F.struct("src", "h")).alias("p"))
        return o.join(n, ["mesh_id", "dst"], "left").join(p, ["mesh_id", "src"], "left").select("mesh_id", "h", "e", "src", "dst", F.col("n.h").alias("next_h"), F.col("p.h").alias("prev_h"))

    @cached_property
    def halfedges(self) -> DataFrame:
        """(mesh_id, h, e, src, dst, f, slot, next_h, prev_h); h ^ 1 is the opposite.

        What needs no next and previous takes ``half_ids`` or ``half_sides``, which are cheaper.
        """
        own = "half_sides" not in self.__dict__
        names = ("mesh_id", "h", "e", "src", "dst", "f", "slot", "next_h", "prev_h")
        sides = self.half_sides
        face = Window.partitionBy("mesh_id", "f")
        # Of a side from a vertex to itself, which both its half-edges run along, the first is next and previous.
        at = lambda k: F.min("h").over(face.orderBy("slot").rangeBetween(k, k))
        end = lambda slot: F.min(F.when(F.col("slot") == slot, F.col("h"))).over(face)
        inner = sides.where("f is not null").withColumns({"next_h": F.coalesce(at(1), end(F.lit(0))), "prev_h": F.coalesce(at(-1), end(F.col("n") - 1))})
        out = staged(inner.select(*names).unionByName(self.open_halfedges(), True).select(*names), "halfedges")
        if own:
            dropped(sides)
            del self.__dict__["half_sides"]
        return out

    # -- counts, boundary ------------------------------------------------------------------------------------

    def counts(self) -> DataFrame:
        """mesh_id, n_vertices, n_edges, n_faces, n_boundary_edges, euler of every mesh."""
        v = self.live_vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
        e = self.radial.groupBy("mesh_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_faces") < 2).alias("n_boundary_edges"))
        f = self.live_faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
        out = v.join(e, "mesh_id", "left").join(f, "mesh_id", "left").na.fill(0)
        return out.select("mesh_id", "n_vertices", "n_edges", "n_faces", "n_boundary_edges", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"))

    def find_halfedge(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (mesh_id, a, b) with the half-edge h from a to b, null where there is none."""
        h = self.half_ids.select("mesh_id", F.col("src").alias("a"), F.col("dst").alias("b"), "h")
        return pairs.join(h, ["mesh_id", "a", "b"], "left")

    def boundary_vertices(self) -> DataFrame:
        """mesh_id, v of vertices on a boundary edge or on no edge."""
        used = self.radial.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v"), F.col("n_faces") < 2)
        used = used.toDF("mesh_id", "v", "open").groupBy("mesh_id", "v").agg(F.bool_or("open").alias("open"))
        return self.live_vertices.select("mesh_id", "v").join(used, ["mesh_id", "v"], "left").where(F.coalesce("open", F.lit(True))).select("mesh_id", "v")

    def boundary_faces(self) -> DataFrame:
        return self.radial.where("n_faces = 1").select("mesh_id", F.col("first.f").alias("f")).distinct()

    def isolated_vertices(self) -> DataFrame:
        return self.live_vertices.select("mesh_id", "v").join(self.corners.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti")

    def outgoing(self) -> DataFrame:
        """mesh_id, v, h: a vertex's stored half-edge, a boundary one if there is any, else the least."""
        first = F.min(F.struct(F.col("f").isNotNull().alias("inner"), "h"))
        return self.half_sides.groupBy("mesh_id", F.col("src").alias("v")).agg(first.alias("k")).select("mesh_id", "v", "k.h")

    def face_halfedge(self) -> DataFrame:
        """mesh_id, f, h: a face's stored half-edge, its last side."""
        last = F.max(F.struct("slot", "h"))
        return self.half_sides.where("f is not null").groupBy("mesh_id", "f").agg(last.alias("k")).select("mesh_id", "f", "k.h")

    # -- neighbourhoods --------------------------------------------------------------------------------------

    def valence(self) -> DataFrame:
        """mesh_id, v, valence of vertices with an edge."""
        return self.radial.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v")).groupBy("mesh_id", "v").agg(F.count("*").alias("valence"))

    def one_ring(self) -> DataFrame:
        """mesh_id, v, ring: the neighbours of a vertex, sorted."""
        both = F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("w")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("w")))
        return self.radial.select("mesh_id", F.inline(both)).groupBy("mesh_id", "v").agg(F.sort_array(F.collect_list("w")).alias("ring"))

    def fans(self) -> DataFrame:
        """mesh_id, v, ring of every vertex with a face: as in ``ordered_ring``, null where it leaves the vertex out."""
        c = self.corners.groupBy("mesh_id", "v").agg(F.sort_array(F.collect_list(F.struct("prev_v", "next_v"))).alias("steps"))
        # Only the first step from each neighbour goes into the map, so that its keys differ whatever the faces are.
        first = F.filter("steps", lambda s, i: (i == 0) | (F.get("steps", i - 1)["prev_v"] < s["prev_v"]))
        c = c.withColumn("turn", F.map_from_entries(first)).withColumn("heads", F.array_except(F.map_keys("turn"), F.map_values("turn")))
        one = F.expr("size(turn) = size(steps) and size(array_distinct(map_values(turn))) = size(steps) and size(heads) <= 1")
        start = F.coalesce(F.get("heads", F.lit(0)), F.array_min(F.map_keys("turn")))
        ring = "aggregate(sequence(1, size(turn)), array(start), (a, i) -> case when turn[element_at(a, -1)] is null or turn[element_at(a, -1)] = a[0] then a else a || array(turn[element_at(a, -1)]) end)"
        c = c.withColumn("start", start).withColumn("ring", F.when(one, F.expr(ring)))
        return c.select("mesh_id", "v", F.when(F.expr("size(ring) = size(turn) + size(heads)"), F.col("ring")).alias("ring"))

    def ordered_ring(self) -> DataFrame:
        """mesh_id, v, ring: the neighbours in turning order.

        Turning from neighbour prev_v leads to next_v.  An open fan starts at its boundary, a closed one at its
        least neighbour.  Vertices with several fans or repeated sides are left out.
        """
        return self.fans().where("ring is not null")

    def vertex_faces(self) -> DataFrame:
        return self.corners.groupBy("mesh_id", "v").agg(F.sort_array(F.collect_set("f")).alias("faces"))

    def vertex_edges(self) -> DataFrame:
        return self.edges.select("mesh_id", "e", F.explode(F.array("v0", "v1")).alias("v")).groupBy("mesh_id", "v").agg(F.sort_array(F.collect_list("e")).alias("edges"))

    def vertex_halfedges(self, incoming: bool = False) -> DataFrame:
        """mesh_id, v, halfedges: those that leave a vertex, or arrive at it."""
        return self.half_ids.groupBy("mesh_id", F.col("dst" if incoming else "src").alias("v")).agg(F.sort_array(F.collect_list("h")).alias("halfedges"))

    def _by_side(self, column: str, name: str) -> DataFrame:
        """A column of a face's half-edges, starting at its last side."""
        turn = F.struct(((F.col("slot") + 1) % F.col("n")).alias("k"), F.col(column).alias("x"))
        return self.half_sides.where("f is not null").groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["x"]).alias(name))

    def face_halfedges(self) -> DataFrame:
        return self._by_side("h", "halfedges")

    def face_edges(self) -> DataFrame:
        return self._by_side("e", "edges")

    def face_vertices(self) -> DataFrame:
        return self.live_faces.select("mesh_id", "f", "verts")

    def face_faces(self) -> DataFrame:
        """mesh_id, f, g: one row for each side of f that g is across of."""
        c = self.corners
        other = c.select("mesh_id", F.col("v").alias("next_v"), F.col("next_v").alias("v"), F.col("f").alias("g"))
        return c.join(other, ["mesh_id", "v", "next_v"]).select("mesh_id", "f", "g")

    # -- deletion, compaction --------------------------------------------------------------------------------

    def delete_faces(self, ids: DataFrame, isolated: bool = True) -> MeshFrame:
        """Without the faces of ``ids`` (mesh_id, f); with ``isolated``, without vertices that lose all faces."""
        keep = self.live_faces.join(ids.select("mesh_id", "f"), ["mesh_id", "f"], "left_anti").select(self.faces.columns)
        if not isolated:
            return replace(self, faces=keep)
        gone = self.live_faces.join(ids.select("mesh_id", "f"), ["mesh_id", "f"], "left_semi").select("mesh_id", F.explode("verts").alias("v"))
        lost = gone.join(keep.select("mesh_id", F.explode("verts").alias("v")), ["mesh_id", "v"], "left_anti").distinct()
        return replace(self, vertices=self.vertices.join(lost, ["mesh_id", "v"], "left_anti").select(self.vertices.columns), faces=keep)

    def delete_vertices(self, ids: DataFrame, isolated: bool = True) -> MeshFrame:
        """Without the vertices of ``ids`` (mesh_id, v) and the faces on them."""
        faces = self.corners.join(ids.select("mesh_id", "v"), ["mesh_id", "v"], "left_semi").select("mesh_id", "f").distinct()
        m = self.delete_faces(faces, isolated)
        return replace(m, vertices=m.vertices.join(ids.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti").select(self.vertices.columns))

    def delete_edges(self, ids: DataFrame, isolated: bool = True) -> MeshFrame:
        """Without the faces on the edges of ``ids`` (mesh_id, lo, hi)."""
        c = self.corners.select("mesh_id", "f", F.least("v", "next_v").alias("lo"), F.greatest("v", "next_v").alias("hi"))
        return self.delete_faces(c.join(ids.select("mesh_id", "lo", "hi"), ["mesh_id", "lo", "hi"], "left_semi").select("mesh_id", "f").distinct(), isolated)

    def compacted(self) -> MeshFrame:
        """Without tombstones, ids dense and in their old order; properties stay with their rows."""
        v = numbered(self.live_vertices, "__v", F.col("v"))
        ids = v.select("mesh_id", "v", F.col("__v").alias("w"))
        c = self.live_faces.select("mesh_id", "f", F.posexplode("verts").alias("slot", "v")).join(ids, ["mesh_id", "v"])
        lists = c.groupBy("mesh_id", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "w"))), lambda t: t["w"]).alias("__verts"))
        f = numbered(self.live_faces.join(lists, ["mesh_id", "f"]), "__f", F.col("f"))
        v = v.withColumn("v", F.col("__v")).select([c for c in self.vertices.columns if c != "deleted"])
        f = f.withColumns({"f": F.col("__f"), "verts": F.col("__verts")}).select([c for c in self.faces.columns if c != "deleted"])
        return MeshFrame(v, f, self._moved("edge", ids), self._moved("halfedge", ids))

    def _moved(self, element: str, ids: DataFrame) -> DataFrame | None:
        """The values of edges or half-edges under the new ``ids`` (mesh_id, v, w) of their ends."""
        rows = self.edge_values if element == "edge" else self.halfedge_values
        if rows is None:
            return None
        _, a, b = KEYS[element]
        moved = rows
        for end in (a, b):
            moved = moved.join(ids.select("mesh_id", F.col("v").alias(end), F.col("w").alias(f"__{end}")), ["mesh_id", end])
        # New ids keep the order of the old ones, so the lesser end stays the lesser one.
        return moved.select("mesh_id", F.col(f"__{a}").alias(a), F.col(f"__{b}").alias(b), *[c for c in rows.columns if c not in KEYS[element]])

    # -- properties, status ----------------------------------------------------------------------------------

    def _table(self, element: str) -> DataFrame | None:
        return {"vertex": self.vertices, "face": self.faces, "edge": self.edge_values, "halfedge": self.halfedge_values}[element]

    def _with_table(self, element: str, rows: DataFrame | None) -> MeshFrame:
        return replace(self, **{{"vertex": "vertices", "face": "faces", "edge": "edge_values", "halfedge": "halfedge_values"}[element]: rows})

    def with_property(self, element: str, name: str, kind: str, default=None) -> MeshFrame:
        """With a property of type float, int or vec3 of vertices, faces, edges or half-edges; the default is zero."""
        if default is None:
            default = (0.0, 0.0, 0.0) if kind == "vec3" else 0
        value = F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("xyz", default, strict=True)]) if kind == "vec3" else F.lit(default)
        rows = self._table(element)
        if rows is None:
            at = self.radial if element == "edge" else self.corners.withColumnsRenamed({"v": "src", "next_v": "dst"})
            rows = at.select(*KEYS[element]).limit(0)  # only its schema: values that are not set are defaults
        column = value.cast(PROPERTY_TYPES[kind]).alias(name, metadata={"default": list(map(float, default)) if kind == "vec3" else default})
        return self._with_table(element, rows.select(*[F.col(c) for c in rows.columns if c != name], column))

    def without_property(self, element: str, name: str) -> MeshFrame:
        rows = self._table(element)
        return self if rows is None else self._with_table(element, rows.drop(name))

    def n_properties(self, element: str) -> int:
        rows = self._table(element)
        return 0 if rows is None else len([c for c in rows.columns if c not in OWN])

    def values(self, element: str) -> DataFrame:
        """Vertices, faces, edges or half-edges with their ids and properties."""
        if element in ("vertex", "face"):
            return self._table(element)
        rows, ids = self._table(element), self.edges.select("mesh_id", "e", "lo", "hi") if element == "edge" else self.half_ids.select("mesh_id", "h", "src", "dst")
        if rows is None:
            return ids
        own = [c for c in rows.columns if c not in KEYS[element]]
        both = ids.join(rows.withColumn("__set", F.lit(True)), list(KEYS[element]), "left")
        filled = [_kept(rows, c, F.when(F.col("__set"), F.col(c)).otherwise(_default(rows, c))) for c in own]
        return both.select(*ids.columns, *filled)

    def set_values(self, element: str, name: str, rows: DataFrame) -> MeshFrame:
        """With the values of ``rows`` (mesh_id, v, f, e or h, value) in column ``name``; other elements keep theirs."""
        key, old = list(KEYS[element]), self._table(element)
        if element in ("edge", "halfedge"):
            ids = self.edges.select("mesh_id", "e", "lo", "hi") if element == "edge" else self.half_ids.select("mesh_id", "h", "src", "dst")
            rows = rows.join(ids, ["mesh_id", "e" if element == "edge" else "h"])
        new = old.join(rows.select(*key, F.col("value").alias("__new")), key, "left" if element in ("vertex", "face") else "full")
        filled = [F.col(c) if c in key else F.coalesce(F.col("__new"), F.col(c), _default(old, c)) if c == name else F.coalesce(F.col(c), _default(old, c)) if element in ("edge", "halfedge") else F.col(c) for c in old.columns]
        return self._with_table(element, new.select(*[_kept(old, c, x) for c, x in zip(old.columns, filled, strict=True)]))

    def change_status(self, element: str, flag: str, rows: DataFrame) -> MeshFrame:
        """With a status flag of elements set or cleared as ``rows`` (mesh_id, v, f, e or h, on) say."""
        m, ident = self, {"vertex": "v", "face": "f", "edge": "e", "halfedge": "h"}[element]
        if self._table(element) is None or "status" not in self._table(element).columns:
            m = self.with_property(element, "status", "int", 0)
        now = m.values(element).select("mesh_id", ident, F.col("status").alias("__status")).join(rows.select("mesh_id", ident, "on"), ["mesh_id", ident])
        bit = F.lit(FLAGS[flag])
        value = F.when(F.col("on"), F.coalesce("__status", F.lit(0)).bitwiseOR(bit)).otherwise(F.coalesce("__status", F.lit(0)).bitwiseAND(F.bitwise_not(bit)))
        return m.set_values(element, "status", now.select("mesh_id", ident, value.cast("int").alias("value")))


def status(rows: DataFrame) -> Column:
    return F.coalesce("status", F.lit(0)) if "status" in rows.columns else F.lit(0)


def test_status(rows: DataFrame, flag: str) -> Column:
    """Whether a flag is set."""
    return status(rows).bitwiseAND(FLAGS[flag]) != 0


test_status.__test__ = False


def change_status(rows: DataFrame, flag: str, on: Column) -> DataFrame:
    """``rows`` with a flag set where ``on`` is true and cleared where it is false."""
    s = status(rows)
    return rows.withColumn("status", F.when(on, s.bitwiseOR(FLAGS[flag])).otherwise(s.bitwiseAND(~FLAGS[flag])))
