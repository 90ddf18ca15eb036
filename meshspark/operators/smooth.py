"""Smoothing: every step moves all interior vertices at once from the positions before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.functions.shared import dropped, staged

from .frame import MeshFrame
from .geometry import points
from .subdivide import _ring_means

#: Weights below this count as none.
TINY = 1e-20


def _moved(m: MeshFrame, goal: DataFrame, rate: float) -> MeshFrame:
    """Interior vertices moved by ``rate`` towards ``goal`` (mesh_id, v, mean)."""
    b = m.boundary_vertices().withColumn("open", F.lit(True))
    v = m.vertices.join(goal.select("mesh_id", "v", "mean"), ["mesh_id", "v"], "left").join(b, ["mesh_id", "v"], "left")
    at = V.add(V.point(), V.scale(V.sub(F.col("mean"), V.point()), rate))
    v = v.withColumn("at", F.when(F.col("open").isNull() & F.col("mean").isNotNull(), at).otherwise(V.point()))
    return MeshFrame(v.withColumns({c: F.col(f"at.{c}") for c in "xyz"}).select(m.vertices.columns), m.faces)


def _steps(m: MeshFrame, goal, iterations: int, rate: float) -> MeshFrame:
    last = None
    for k in range(iterations):
        m = _moved(m, goal(m), rate)
        if k + 1 < iterations:
            v = staged(m.vertices, "smooth")
            if last is not None:
                dropped(last)
            m, last = MeshFrame(v, m.faces), v
    return m


def laplacian_smooth(m: MeshFrame, iterations: int = 1, rate: float = 0.5) -> MeshFrame:
    """Towards the mean of the neighbours."""
    return _steps(m, _ring_means, iterations, rate)


def cotan_means(m: MeshFrame) -> DataFrame:
    """mesh_id, v, mean: the neighbours' mean weighted by the cotangents of the angles across each edge."""
    c = m.corners.where("n = 3").select("mesh_id", "v", "next_v", "after_v")
    c = c.join(points(m, "v", "p"), ["mesh_id", "v"]).join(points(m, "next_v", "q"), ["mesh_id", "next_v"]).join(points(m, "after_v", "o"), ["mesh_id", "after_v"])
    a, b = V.sub(F.col("p"), F.col("o")), V.sub(F.col("q"), F.col("o"))
    sine = V.norm(V.cross(a, b))
    c = c.withColumn("w", F.when(sine < TINY, 0.0).otherwise(V.dot(a, b) / F.greatest(sine, F.lit(TINY))))
    both = F.array(F.struct("v", F.col("q").alias("to")), F.struct(F.col("next_v").alias("v"), F.col("p").alias("to")))
    s = c.select("mesh_id", "w", F.inline(both)).groupBy("mesh_id", "v").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"to.{k}")).alias(k) for k in "xyz"])
    return s.where(F.abs("w") > TINY).select("mesh_id", "v", V.scale(V.point(), 1 / F.col("w")).alias("mean"))


def cotan_smooth(m: MeshFrame, iterations: int = 1, rate: float = 0.5) -> MeshFrame:
    return _steps(m, cotan_means, iterations, rate)
