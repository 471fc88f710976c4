"""Terrain meshes as binary glTF, read again to verify."""

from __future__ import annotations

import json
import re
import struct
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grid_mesh(z: np.ndarray, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(vertices (n, 3) of float32, triangles (m, 3) of uint32): y up, centred; squares that touch NaN are left out."""
    h, w = z.shape
    ok = np.isfinite(z)
    number = np.cumsum(ok.ravel()).reshape(h, w) - 1
    r, c = np.nonzero(ok)
    v = np.stack([(c - (w - 1) / 2) * cell, z[ok], (r - (h - 1) / 2) * cell], axis=1).astype(np.float32)
    full = ok[:-1, :-1] & ok[1:, :-1] & ok[:-1, 1:] & ok[1:, 1:]
    a, b, d, e = (number[s][full] for s in ((slice(None, -1), slice(None, -1)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)), (slice(1, None), slice(1, None))))
    return v, np.concatenate([np.stack([a, b, d], 1), np.stack([d, b, e], 1)]).astype(np.uint32)


def glb_bytes(v: np.ndarray, t: np.ndarray, extras: dict | None = None) -> bytes:
    body = v.tobytes() + t.tobytes()
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "extras": extras or {}}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": len(body)}], "bufferViews": [{"buffer": 0, "byteLength": v.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": v.nbytes, "byteLength": t.nbytes, "target": 34963}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3", "min": v.min(axis=0).tolist(), "max": v.max(axis=0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": int(t.size), "type": "SCALAR"}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def parse_glb(data: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    if data[:4] != b"glTF" or struct.unpack_from("<I", data, 8)[0] != len(data):
        raise ValueError("not a whole GLB file")
    n = struct.unpack_from("<I", data, 12)[0]
    doc = json.loads(data[20 : 20 + n])
    at = 28 + n
    v, t = doc["accessors"]
    views = doc["bufferViews"]
    return np.frombuffer(data, np.float32, v["count"] * 3, at).reshape(-1, 3), np.frombuffer(data, np.uint32, t["count"], at + views[1]["byteOffset"]).reshape(-1, 3), doc["nodes"][0].get("extras", {})


#: Fixed value: the extension of compressed meshes.
COMPRESSED = "KHR_draco_mesh_compression"


def inspected(data: bytes) -> dict:
    """What a GLB file says of itself, its header and chunks checked: bytes, primitives, and how many of them are compressed."""
    if len(data) < 20 or data[:4] != b"glTF":
        raise ValueError("not a GLB file")
    version, length = struct.unpack_from("<II", data, 4)
    if version != 2 or length != len(data):
        raise ValueError(f"a GLB file of version {version} and {length} bytes was expected to be of version 2 and {len(data)}")
    chunks, at = [], 12
    while at < length:
        n, kind = struct.unpack_from("<I4s", data, at)
        if at + 8 + n > length:
            raise ValueError("a chunk overruns the GLB file")
        chunks.append((kind, data[at + 8 : at + 8 + n]))
        at += 8 + n
    if not chunks or chunks[0][0] != b"JSON":
        raise ValueError("the first chunk of a GLB file has to be JSON")
    doc = json.loads(chunks[0][1])
    primitives = [p for m in doc.get("meshes", []) for p in m.get("primitives", [])]
    return {"bytes": length, "primitives": len(primitives), "compressed": sum(COMPRESSED in p.get("extensions", {}) for p in primitives), "uses": COMPRESSED in doc.get("extensionsUsed", [])}


def export_name(source: str, product: str, mode: str, compressed: bool = False) -> str:
    """<source>_<product>_<mode>.glb, without folders and other characters than letters, digits, dots, dashes and underscores."""
    base = re.sub(r"\.[^.]*$", "", re.split(r"[\\/]", source or "terrain")[-1]) or "terrain"
    stem = base if base.endswith(product) else f"{base}_{product}"
    return re.sub(r"[^A-Za-z0-9._-]", "_", f"{stem}_{mode}{'_draco' if compressed else ''}.glb")


def export_meshes(cells: DataFrame, by: Sequence[str], value: str, product: str, mode: str, cell: float = 1.0, compressed: bool = False, encoder: Callable[[np.ndarray, np.ndarray, dict], bytes] | None = None, now: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(name, content, problems, vertices, triangles, export_ms) of each grid of cells (by, row, col, value) as a mesh, read again to verify. A grid is one group: tile large ones.

    encoder makes the bytes of vertices, triangles and extras, glb_bytes by default; compression needs one that compresses, and a file that does not say so is a problem, as is one that
    says so unasked. now is the clock, in seconds."""
    if compressed and encoder is None:
        raise ValueError("compression is asked for but no encoder is given; nothing is exported")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began = now()
        z = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
        z[pdf["row"], pdf["col"]] = pdf[value].to_numpy(float)
        source, bad, data = "-".join(str(pdf[b].iloc[0]) for b in by), [], b""
        v, t = grid_mesh(z, cell)
        if not len(t):
            bad.append("no square of valid cells")
        else:
            data = (encoder or glb_bytes)(v, t, {"product": product, "mode": mode, "vertices": len(v), "triangles": len(t)})
            told = inspected(data)
            if compressed and not (told["uses"] and told["compressed"] == told["primitives"] > 0):
                bad.append("compression was asked for but the file is not compressed")
            if not compressed and told["uses"]:
                bad.append("the file is compressed, unasked")
            if encoder is None:
                w, s, _ = parse_glb(data)
                bad += [] if np.array_equal(v, w) and np.array_equal(t, s) else ["the mesh differs when it is read again"]
        return pd.DataFrame([(export_name(source, product, mode, compressed), data, bad, len(v), len(t), (now() - began) * 1000)], columns=["name", "content", "problems", "vertices", "triangles", "export_ms"])

    return cells.groupBy(*by).applyInPandas(run, "name string, content binary, problems array<string>, vertices long, triangles long, export_ms double")
