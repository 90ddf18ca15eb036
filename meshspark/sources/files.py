"""Mesh files: OBJ, PLY, STL and OFF, read on the executors and written mesh by mesh.

``read`` takes a file, a folder or a glob that Spark can open; every file is one mesh, named by a hash of its path.
With soup=True, STL corners stay apart and faces are as in the file; otherwise STL corners of equal single-precision
positions are one vertex.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.functions.shared import staged
from meshspark.operators.edit import triangulated
from meshspark.operators.frame import MeshFrame
from meshspark.operators.geometry import face_measures

FORMATS = ("obj", "ply", "stl", "off")
#: Scalar types of PLY and what they are called.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}

Raw = tuple[np.ndarray, list[list[int]]]


def parse_obj(data: bytes) -> Raw:
    """v and f lines; of a corner a/b/c only the vertex counts; negative indices count from the last vertex so far."""
    points, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            points.append([float(x) for x in w[1:4]])
        elif w[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in w[1:]]
            faces.append([i - 1 if i > 0 else len(points) + i for i in at])
    return np.array(points, float).reshape(-1, 3), faces


def parse_off(data: bytes) -> Raw:
    """OFF; blank lines and # comments are skipped, counts may follow on the first line."""
    w = re.sub(r"#[^\n]*", "", data.decode("utf-8", "replace")).split()
    if not w or w[0] != "OFF":
        raise ValueError("not an OFF file")
    nv, nf, at = int(w[1]), int(w[2]), 4
    points = np.array(w[at : at + 3 * nv], float).reshape(-1, 3)
    # A face's line may go on with colours, so faces are taken by line.
    lines = [x for x in (y.split("#")[0].split() for y in data.decode("utf-8", "replace").splitlines()) if x]
    skip = (1 if lines[0] != ["OFF"] else 2) + nv
    return points, [[int(i) for i in x[1 : 1 + int(x[0])]] for x in lines[skip : skip + nf]]


def parse_stl(data: bytes) -> Raw:
    """Binary if the size says so, else ASCII; three vertices for each triangle."""
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        rows = np.frombuffer(data, np.dtype([("normal", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        points = rows["p"].reshape(-1, 3).astype(float)
    else:
        points = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)).astype(float).reshape(-1, 3)
    return points, np.arange(len(points) // 3 * 3).reshape(-1, 3).tolist()


def welded(raw: Raw) -> Raw:
    """Corners of equal single-precision positions as one vertex, in the order of their first use."""
    points, faces = raw
    single = points.astype(np.float32) + np.float32(0)
    _, first, inverse = np.unique(single, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return points[first[order]], [rank[inverse.ravel()[f]].tolist() for f in map(np.array, faces)]


def parse_ply(data: bytes) -> Raw:
    """ASCII and little-endian binary; further properties are skipped."""
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    kind, elements = "", []
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[2:-1] if w[1] == "list" else w[1:-1]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {kind or 'unknown'} is not supported")
    points, faces, at = np.zeros((0, 3)), [], 0
    words = body.split() if kind == "ascii" else []

    def take(t: str):
        nonlocal at
        if kind == "ascii":
            at += 1
            return float(words[at - 1]) if PLY_TYPES[t][0] == "f" else int(float(words[at - 1]))
        d = np.dtype("<" + PLY_TYPES[t])
        at += d.itemsize
        return np.frombuffer(body, d, 1, at - d.itemsize)[0].item()

    for name, n, props in elements:
        if kind != "ascii" and all(len(t) == 1 for _, t in props):
            d = np.dtype([(p, "<" + PLY_TYPES[t[0]]) for p, t in props])
            rows = np.frombuffer(body, d, n, at)
            at += d.itemsize * n
            if name == "vertex":
                points = np.stack([rows[c].astype(float) for c in "xyz"], 1)
            continue
        got = []
        for _ in range(n):
            row = {}
            for p, t in props:
                row[p] = take(t[0]) if len(t) == 1 else [take(t[1]) for _ in range(int(take(t[0])))]
            got.append(row)
        if name == "vertex":
            points = np.array([[r[c] for c in "xyz"] for r in got], float).reshape(-1, 3)
        elif name == "face":
            faces = [next(([int(i) for i in v] for v in r.values() if isinstance(v, list)), []) for r in got]
    return points, faces


PARSERS = {"obj": parse_obj, "ply": parse_ply, "stl": parse_stl, "off": parse_off}
_ROWS = "mesh_id bigint, kind int, id bigint, x double, y double, z double, verts array<bigint>"


def _parser(soup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mesh, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                if kind not in PARSERS:
                    raise ValueError(f"unknown mesh format: {path}")
                points, faces = PARSERS[kind](content)
                if kind == "stl" and not soup:
                    points, faces = welded((points, faces))
                n, k = len(points), len(faces)
                none = pa.nulls(k, pa.float64())
                cols = [pa.concat_arrays([pa.array(points[:, a], pa.float64()), none]) for a in range(3)]
                verts = pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array(faces, pa.list_(pa.int64()))])
                ids = pa.array(np.r_[np.arange(n), np.arange(k)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * (n + k), pa.int64()), pa.array([0] * n + [1] * k, pa.int32()), ids, *cols, verts], ["mesh_id", "kind", "id", "x", "y", "z", "verts"])

    return run


def read(spark: SparkSession, path: str, soup: bool = False) -> MeshFrame:
    """The meshes of the files at ``path``; faces that name a missing vertex raise when they are used."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("mesh_id"), "path", "content")
    rows = staged(files.mapInArrow(_parser(soup), _ROWS), "mesh-files")
    return MeshFrame(rows.where("kind = 0").select("mesh_id", F.col("id").alias("v"), *"xyz"), rows.where("kind = 1").select("mesh_id", F.col("id").alias("f"), "verts"))


def bad_faces(m: MeshFrame) -> DataFrame:
    """mesh_id, f of faces that name a vertex the mesh doesn't have."""
    return m.corners.select("mesh_id", "f", "v").join(m.live_vertices.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti").select("mesh_id", "f").distinct()


def _g(x: float, digits: int) -> str:
    return f"{x:.{digits}g}"


def encode(kind: str, points: np.ndarray, faces: list[list[int]], normals: np.ndarray, binary: bool, digits: int) -> bytes:
    """A mesh as the bytes of a file; vertices are numbered densely."""
    text = lambda p: " ".join(_g(x, digits) for x in p)
    if kind == "obj":
        return "".join([f"v {text(p)}\n" for p in points] + [f"f {' '.join(str(i + 1) for i in f)}\n" for f in faces]).encode()
    if kind == "off":
        return (f"OFF\n{len(points)} {len(faces)} 0\n" + "".join([f"{text(p)}\n" for p in points] + [f"{len(f)} {' '.join(map(str, f))}\n" for f in faces])).encode()
    if kind == "ply":
        form = "binary_little_endian" if binary else "ascii"
        head = f"ply\nformat {form} 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n".encode()
        if binary:
            return head + points.astype("<f4").tobytes() + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in faces)
        return head + "".join([f"{text(p)}\n" for p in points] + [f"{len(f)} {' '.join(map(str, f))}\n" for f in faces]).encode()
    if kind == "stl":
        t = points[np.array(faces, int).reshape(-1, 3)]
        if binary:
            rows = np.zeros(len(t), np.dtype([("normal", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]))
            rows["normal"], rows["p"] = normals, t
            return b"\0" * 80 + struct.pack("<I", len(t)) + rows.tobytes()
        return ("solid mesh\n" + "".join(f"facet normal {text(n)}\nouter loop\n" + "".join(f"vertex {text(p)}\n" for p in q) + "endloop\nendfacet\n" for n, q in zip(normals, t, strict=True)) + "endsolid mesh\n").encode()
    raise ValueError(f"unknown mesh format: {kind}")


def _encoder(kind: str, binary: bool, digits: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("id", "ascending")])
        rows = t.to_pylist()
        v, f = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        points = np.array([[r["x"], r["y"], r["z"]] for r in v], float).reshape(-1, 3)
        normals = np.array([[r["x"], r["y"], r["z"]] for r in f], float).reshape(-1, 3)
        data = encode(kind, points, [r["verts"] for r in f], normals, binary, digits)
        return pa.table({"mesh_id": pa.array([rows[0]["mesh_id"]], pa.int64()), "content": pa.array([data], pa.binary())})

    return run


def encoded(m: MeshFrame, kind: str, binary: bool = False, digits: int = 6) -> DataFrame:
    """mesh_id, content: every mesh as the bytes of a file, in Python workers; STL takes polygons as fans."""
    m = (triangulated(m) if kind == "stl" else m).compacted()
    v = m.vertices.select("mesh_id", F.lit(0).alias("kind"), F.col("v").alias("id"), *"xyz", F.lit(None).cast("array<bigint>").alias("verts"))
    n = face_measures(m).select("mesh_id", "f", "normal") if kind == "stl" else m.faces.select("mesh_id", "f", F.lit(None).cast("struct<x:double,y:double,z:double>").alias("normal"))
    f = m.faces.select("mesh_id", "f", "verts").join(n, ["mesh_id", "f"]).select("mesh_id", F.lit(1).alias("kind"), F.col("f").alias("id"), *[F.col(f"normal.{c}").alias(c) for c in "xyz"], "verts")
    return v.unionByName(f).groupBy("mesh_id").applyInArrow(_encoder(kind, binary, digits), "mesh_id bigint, content binary")


def write(m: MeshFrame, folder: str, kind: str, binary: bool = False, digits: int = 6) -> list[str]:
    """Writes every mesh to <folder>/<mesh_id>.<kind> through Spark's file systems, one at a time; the paths."""
    spark, out = m.vertices.sparkSession, []
    for row in encoded(m, kind, binary, digits).toLocalIterator():
        path = f"{folder.rstrip('/')}/{row['mesh_id']}.{kind}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        stream.write(bytearray(row["content"]))
        stream.close()
        out.append(path)
    return out
