"""Vectors: Column helpers over struct<x, y, z>, and a plain Python Vec3."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors shorter than this have no direction.
TINY = 1e-30


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vec(x, y, z) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, int | float) else F.col(x)


def point(prefix: str = "") -> Column:
    """The vector of columns <prefix>x, <prefix>y, <prefix>z."""
    return vec(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, k) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The unit vector; a vector without direction stays as it is."""
    return let(a, lambda v: F.when(norm(v) > TINY, scale(v, 1 / norm(v))).otherwise(v))


def equal(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])


def angle(a: Column, b: Column) -> Column:
    """The angle between two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def newell(points: Column) -> Column:
    """Twice the vector area of a polygon given as array<struct<x, y, z>>."""

    def of(p: Column) -> Column:
        zero = vec(0.0, 0.0, 0.0)
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), zero, lambda a, i: add(a, cross(sub(F.get(p, i), F.get(p, F.lit(0))), sub(F.get(p, (i + 1) % F.size(p)), F.get(p, F.lit(0))))))

    return let(points, of)


class Vec3(NamedTuple):
    """A vector outside DataFrames."""

    x: float = 0.0
    y: float = 0.0
    z: float = 0.0

    def __add__(self, o):
        return Vec3(*(a + b for a, b in zip(self, o, strict=True)))

    def __sub__(self, o):
        return Vec3(*(a - b for a, b in zip(self, o, strict=True)))

    def __mul__(self, k: float):
        return Vec3(*(a * k for a in self))

    __rmul__ = __mul__

    def __truediv__(self, k: float):
        return Vec3(*(a / k for a in self))

    def __neg__(self):
        return self * -1.0

    def dot(self, o) -> float:
        return sum(a * b for a, b in zip(self, o, strict=True))

    def cross(self, o) -> Vec3:
        return Vec3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def sqrnorm(self) -> float:
        return self.dot(self)

    def norm(self) -> float:
        return self.sqrnorm() ** 0.5

    def normalized(self) -> Vec3:
        n = self.norm()
        return self / n if n > TINY else self
