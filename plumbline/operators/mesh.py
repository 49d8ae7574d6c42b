"""Mesh rows: outlines extruded to prisms, welded vertices, normals, and a binary scene writer.

A mesh is rows of (id, tri, vtx, x, y, z): geometry is emitted per instance by a small kernel, everything after it
(welding, normals, bounds) is relational.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "id long, tri int, vtx int, x double, y double, z double"


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon, counter-clockwise."""
    n = len(ring)
    area = sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n))
    idx = list(range(n)) if area > 0 else list(range(n - 1, -1, -1))
    turn = lambda a, b, c: (ring[b][0] - ring[a][0]) * (ring[c][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[c][0] - ring[a][0])
    out = []
    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            if turn(a, b, c) <= 0:
                continue
            if any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in idx if p not in (a, b, c)):
                continue
            out.append((a, b, c))
            del idx[k]
            break
        else:
            break  # not simple: what is left stays open
    if len(idx) == 3:
        out.append(tuple(idx))
    return out


def prism(ring: np.ndarray, z0: float, z1: float) -> np.ndarray:
    """Walls and roof of an extruded outline, (triangles, 3, 3)."""
    n = len(ring)
    if sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n)) < 0:
        ring = ring[::-1]
    out = []
    for i in range(n):
        (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
        out += [[(ax, ay, z0), (bx, by, z0), (bx, by, z1)], [(ax, ay, z0), (bx, by, z1), (ax, ay, z1)]]
    out += [[(*ring[i], z1) for i in t] for t in ear_clip(ring)]
    return np.array(out)


def footprint_prisms(buildings: DataFrame) -> DataFrame:
    """Mesh rows of (id, ring, z0, z1) rows; a row is one small kernel call."""

    def kernel(frames):
        for f in frames:
            parts = []
            for r in f.itertuples():
                t = prism(np.array([(p["x"], p["y"]) for p in r.ring]), r.z0, r.z1)
                k = np.arange(len(t))
                parts.append(pd.DataFrame({"id": r.id, "tri": np.repeat(k, 3), "vtx": np.tile(np.arange(3), len(t)), "x": t[..., 0].ravel(), "y": t[..., 1].ravel(), "z": t[..., 2].ravel()}))
            if parts:
                yield pd.concat(parts)

    return buildings.select("id", "ring", "z0", "z1").mapInPandas(kernel, SCHEMA)


def weld(mesh: DataFrame, digits: int = 4) -> DataFrame:
    """(id, tri, a, b, c): vertices equal after rounding share a number within their mesh; slivers are left out."""
    key = [F.round(c, digits) for c in "xyz"]
    v = mesh.withColumn("v", (F.dense_rank().over(Window.partitionBy("id").orderBy(*key)) - 1))
    t = v.groupBy("id", "tri").pivot("vtx", [0, 1, 2]).agg(F.first("v")).withColumnsRenamed({"0": "a", "1": "b", "2": "c"})
    return t.where("a <> b and b <> c and a <> c")


def normals(mesh: DataFrame) -> DataFrame:
    """(id, tri, nx, ny, nz, area) of every triangle."""
    t = mesh.groupBy("id", "tri").agg(*[F.max(F.when(F.col("vtx") == k, F.struct("x", "y", "z"))).alias(f"p{k}") for k in range(3)])
    u, v = ([F.col(f"p{k}.{c}") - F.col(f"p0.{c}") for c in "xyz"] for k in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return t.select("id", "tri", *[F.when(size > 0, c / size).alias("n" + a) for c, a in zip(n, "xyz", strict=True)], (size / 2).alias("area"))


def to_glb(triangles: np.ndarray, name: str = "model") -> bytes:
    """A glTF 2.0 binary of one triangle list (y up), without textures."""
    p = np.ascontiguousarray(triangles.reshape(-1, 3)[:, [0, 2, 1]] * [1, 1, -1], np.float32)
    data = p.tobytes()
    doc = {
        "asset": {"version": "2.0", "generator": "plumbline"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "name": name}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "mode": 4}]}], "buffers": [{"byteLength": len(data)}], "bufferViews": [{"buffer": 0, "byteLength": len(data), "target": 34962}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist() if len(p) else [0, 0, 0], "max": p.max(0).tolist() if len(p) else [0, 0, 0]}],
    }
    head = json.dumps(doc).encode()
    head += b" " * (-len(head) % 4)
    return struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(head) + 8 + len(data)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(data), b"BIN\0") + data


def glb_files(mesh: DataFrame) -> DataFrame:
    """(id, glb): the binary scene of each mesh."""

    def kernel(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["tri", "vtx"])
        return pd.DataFrame({"id": [key[0]], "glb": [to_glb(f[["x", "y", "z"]].to_numpy().reshape(-1, 3, 3), str(key[0]))]})

    return mesh.groupBy("id").applyInPandas(kernel, "id long, glb binary")
