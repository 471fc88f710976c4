"""NPY arrays, versions 1 to 3, both byte orders, C and Fortran order."""

from __future__ import annotations

import ast
import struct

import numpy as np

MAGIC = b"\x93NUMPY"
KINDS = frozenset("f4 f8 u1 i1 b1 u2 i2 u4 i4".split())


def parse_npy(data: bytes) -> np.ndarray:
    if data[:6] != MAGIC:
        raise ValueError("not an NPY file")
    major = data[6]
    if major not in (1, 2, 3):
        raise ValueError(f"NPY version {major} is not known")
    size, at = (struct.unpack_from("<H", data, 8)[0], 10) if major == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    head = ast.literal_eval(data[at : at + size].decode("utf-8" if major == 3 else "latin-1").strip())
    kind, shape = head["descr"], head["shape"]
    if kind.lstrip("<>|=") not in KINDS:
        raise ValueError(f"NPY kind {kind} is not supported")
    n = int(np.prod(shape, dtype=np.int64))
    if len(data) - at - size < n * np.dtype(kind).itemsize:
        raise ValueError("NPY file is cut short")
    return np.frombuffer(data, kind, n, at + size).reshape(shape, order="F" if head["fortran_order"] else "C")


def npy_bytes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    head = f"{{'descr': '{a.dtype.str}', 'fortran_order': False, 'shape': {a.shape!r}, }}"
    pad = -(len(head) + 11) % 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(head) + pad + 1) + (head + " " * pad + "\n").encode() + a.tobytes()
