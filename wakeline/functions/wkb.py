"""Well-known binary geometry (little-endian, two dimensions) at the file boundary, in Arrow batches.

Inside the engine geometry is plain lon/lat columns; only tables exchanged with other tools carry WKB.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte order mark and geometry type codes.
LITTLE_ENDIAN = 1
POINT, LINE = 1, 2
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
PATH = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
_POINT_LAYOUT = np.dtype([("order", "u1"), ("kind", "<u4"), ("lon", "<f8"), ("lat", "<f8")])
_LINE_HEAD = np.dtype([("order", "u1"), ("kind", "<u4"), ("points", "<u4")])


@F.pandas_udf(T.BinaryType())
def point_to_wkb(lon: pd.Series, lat: pd.Series) -> pd.Series:
    """A point without both coordinates is null."""
    cells = np.zeros(len(lon), _POINT_LAYOUT)
    cells["order"], cells["kind"], cells["lon"], cells["lat"] = LITTLE_ENDIAN, POINT, lon, lat
    data, width = cells.tobytes(), _POINT_LAYOUT.itemsize
    known = (lon.notna() & lat.notna()).to_numpy()
    return pd.Series([data[i * width : (i + 1) * width] if k else None for i, k in enumerate(known)], dtype=object)


@F.pandas_udf(T.BinaryType())
def path_to_wkb(lons: pd.Series, lats: pd.Series) -> pd.Series:
    def encode(xs, ys) -> bytes:
        head = np.array([(LITTLE_ENDIAN, LINE, len(xs))], _LINE_HEAD)
        return head.tobytes() + np.column_stack([xs, ys]).astype("<f8").tobytes()

    return pd.Series([encode(x, y) for x, y in zip(lons, lats)], dtype=object)


def _vertices(data: bytes) -> np.ndarray | None:
    """lon and lat of a point or line in either byte order; further ordinates and a reference system id are skipped.

    None for other kinds and for geometry that is cut off.
    """
    if len(data) < 9:
        return None
    order = "<" if data[0] == LITTLE_ENDIAN else ">"
    kind, at = int(np.frombuffer(data, order + "u4", 1, 1)[0]), 5
    ordinates = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M)
    if kind & HAS_SRID:
        at += 4
    kind &= ~(HAS_Z | HAS_M | HAS_SRID)
    # Of the ISO codes, the thousands tell: 1 has z, 2 has m, 3 has both.
    ordinates += (0, 1, 1, 2)[kind // 1000] if kind < 4000 else 0
    kind %= 1000
    if kind == LINE:
        if len(data) < at + 4:
            return None
        points, at = int(np.frombuffer(data, order + "u4", 1, at)[0]), at + 4
    elif kind == POINT:
        points = 1
    else:
        return None
    if len(data) < at + 8 * ordinates * points:
        return None
    return np.frombuffer(data, order + "f8", ordinates * points, at).reshape(points, ordinates)[:, :2]


@F.pandas_udf(PATH)
def wkb_to_path(geometry: pd.Series) -> pd.Series:
    """Vertices of WKB points and lines; null for null, other and broken geometry."""

    def decode(data):
        found = None if data is None else _vertices(data)
        return None if found is None else [{"lon": float(x), "lat": float(y)} for x, y in found]

    return pd.Series([decode(g) for g in geometry], dtype=object)


def point_wkb(lon, lat):
    return point_to_wkb(lon, lat)


def path_wkb(path):
    return path_to_wkb(F.transform(path, lambda p: p["lon"]), F.transform(path, lambda p: p["lat"]))


def _path_of(geometry: str, strict: bool):
    path = wkb_to_path(F.col(geometry))
    if not strict:
        return path
    unknown = F.raise_error(F.lit(f"{geometry}: neither a point nor a line, or cut off"))
    return F.when(F.col(geometry).isNotNull() & path.isNull(), unknown.cast(PATH)).otherwise(path)


def decode_points(df, geometry: str = "geometry", strict: bool = False):
    """Replace a WKB point column by ``lon`` and ``lat``; ``strict`` raises where that is impossible."""
    first = F.get(_path_of(geometry, strict), F.lit(0))
    return df.withColumn("_p", first).withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}).drop("_p", geometry)


def decode_paths(df, geometry: str = "geometry", strict: bool = False):
    """Replace a WKB line column by ``path``; ``strict`` raises where that is impossible."""
    return df.withColumn("path", _path_of(geometry, strict)).drop(geometry)
