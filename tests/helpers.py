"""Comparison of a query with its SQL, and WAV bytes."""

import math
import os
import struct


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(columns)


def wav(values, bits=8, rate=500, size=None, extra=b""):
    """A WAV file: 8 bits unsigned or 16 bits signed; ``size`` overrides the data chunk's; ``extra`` is a LIST chunk's body."""
    data = bytes(int(v) + 128 for v in values) if bits == 8 else struct.pack(f"<{len(values)}h", *map(int, values))
    width = bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * width, width, bits)
    between = struct.pack("<4sI", b"LIST", len(extra)) + extra + b"\0" * (len(extra) % 2) if extra else b""
    body = b"WAVE" + form + between + struct.pack("<4sI", b"data", len(data) if size is None else size) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body
