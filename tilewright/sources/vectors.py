"""Polygon files, encoded polylines and vector tiles: small parsers behind UDFs and table functions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def parse_poly(text: str) -> tuple[str, list[tuple[bool, list[tuple[float, float]]]]]:
    """Name and rings (is_hole, points) of a polygon file.

    A name line, then rings: a header (``!`` first for a hole), points, END; END at the end.
    ValueError where a ring is not closed by END, has under three points, or no outer ring is there.
    """
    lines = [s.strip() for s in text.splitlines() if s.strip()]
    if not lines:
        raise ValueError("empty polygon file")
    name, rings, at = lines[0], [], 1
    while at < len(lines) and lines[at] != "END":
        hole, points, at = lines[at].startswith("!"), [], at + 1
        while at < len(lines) and lines[at] != "END":
            lon, lat = map(float, lines[at].split()[:2])
            points.append((lon, lat))
            at += 1
        if at == len(lines):
            raise ValueError("a ring has no END")
        if len(points) < 3:
            raise ValueError("a ring has under three points")
        rings.append((hole, points))
        at += 1
    if not any(not hole for hole, _ in rings):
        raise ValueError("no outer ring")
    return name, rings


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ring_id, is_hole, seq, lon, lat) of polygon files."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, raw in zip(f["path"], f["content"]):
                name, rings = parse_poly(raw.decode())
                rows = [(at, name, i, int(hole), seq, lon, lat) for i, (hole, points) in enumerate(rings) for seq, (lon, lat) in enumerate(points)]
                yield pd.DataFrame(rows, columns=["path", "name", "ring_id", "is_hole", "seq", "lon", "lat"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.poly").load(path)
    return files.select("path", "content").mapInPandas(each, "path string, name string, ring_id int, is_hole int, seq int, lon double, lat double")


_RINGS = "array<array<array<double>>>"


def poly_geojson(vertices: DataFrame, by: str = "path") -> DataFrame:
    """``(by, feature)``: a GeoJSON feature of each polygon of ``vertices (by, ring_id, is_hole, seq, lon, lat)``, holes honoured.

    Each outer ring is a polygon, with the holes that follow it and come before the next outer ring.
    """
    rings = vertices.groupBy(by, "ring_id", "is_hole").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))  # of one ring
    rings = rings.withColumn("ring", F.transform("p", lambda v: F.array(v["lon"], v["lat"])))
    shape = F.sum((F.col("is_hole") == 0).cast("int")).over(Window.partitionBy(by).orderBy("ring_id"))
    shapes = rings.withColumn("shape", shape).groupBy(by, "shape").agg(F.array_sort(F.collect_list(F.struct("ring_id", "ring"))).alias("r"))
    polygons = shapes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("shape", F.transform("r", lambda x: x["ring"]).alias("rings")))).alias("s"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("s", lambda x: x["rings"]).alias("coordinates"))
    return polygons.select(by, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(by).alias("name")).alias("properties"))).alias("feature"))


def geojson_rings(documents: DataFrame, column: str = "value") -> DataFrame:
    """``(ring_id, is_hole, seq, lon, lat)`` of the polygons in GeoJSON texts: a feature, a collection or a bare geometry.

    All polygons of a text are one shape: what is inside any of them is inside. Other geometries have no rings.
    """
    plain = lambda kind: F.from_json(F.col(column), f"type string, {kind}")
    shape = "struct<type:string,coordinates:string>"
    document = plain(f"features array<struct<geometry:{shape}>>, geometry {shape}, coordinates string")
    one = lambda d: F.struct(d["type"].alias("type"), d["coordinates"].alias("coordinates"))
    listed = F.when(document["type"] == "FeatureCollection", F.transform(document["features"], lambda f: f["geometry"])).when(document["type"] == "Feature", F.array(document["geometry"])).otherwise(F.array(one(document)))
    rows = documents.select(F.xxhash64(column).alias("text"), F.posexplode(listed).alias("feature", "g"))
    rings = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", _RINGS))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{_RINGS}>"))
    polygons = rows.select("text", "feature", F.posexplode(rings).alias("k", "polygon")).select("text", "feature", "k", F.posexplode("polygon").alias("n", "ring"))
    points = polygons.select(F.xxhash64("text", "feature", "k", "n").alias("ring_id"), (F.col("n") > 0).cast("int").alias("is_hole"), F.posexplode("ring").alias("seq", "p"))
    return points.select("ring_id", "is_hole", "seq", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))


def decode_polyline(text: str, precision: int = 6) -> Iterator[tuple[int, float, float]]:
    """(index, lon, lat) of an encoded line; ValueError where it is cut off."""
    at, lat, lon, n = 0, 0, 0, 0
    while at < len(text):
        both = []
        for _ in range(2):
            value = shift = 0
            while True:
                if at >= len(text):
                    raise ValueError("the line is cut off")
                c = ord(text[at]) - 63
                at += 1
                value |= (c & 31) << shift
                shift += 5
                if c < 32:
                    break
            both.append(~(value >> 1) if value & 1 else value >> 1)
        lat, lon = lat + both[0], lon + both[1]
        yield n, lon / 10**precision, lat / 10**precision
        n += 1


def encode_polyline(points: list[tuple[float, float]], precision: int = 6) -> str:
    """The text of a line of (lon, lat), to so many decimals."""
    out, before = [], (0, 0)
    for lon, lat in points:
        now = (round(lat * 10**precision), round(lon * 10**precision))
        for a, b in zip(before, now):
            left = (b - a) << 1 if b >= a else ~((b - a) << 1)
            while left >= 32:
                out.append(chr((left & 31 | 32) + 63))
                left >>= 5
            out.append(chr(left + 63))
        before = now
    return "".join(out)


def polylines(lines: DataFrame, by: str, points: str = "points") -> DataFrame:
    """``(by, polyline)``: the encoded text of each line's array of structs (lon, lat)."""

    @F.pandas_udf("string")
    def encoded(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: None if ps is None else encode_polyline([(p["lon"], p["lat"]) for p in ps]))

    return lines.select(by, encoded(F.col(points)).alias("polyline"))


@udtf(returnType="index int, lon double, lat double")
class DecodePolyline:
    """SQL: ``decode_polyline(text)``."""

    def eval(self, text: str):
        if text is not None:
            yield from decode_polyline(text)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: varints as ints, 64- and 32-bit and length-delimited fields as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"no wire type {kind}")
                size = varint()
            yield key >> 3, raw[at : at + size]
            at += size


def _value(raw: bytes) -> str:
    for number, v in _fields(raw):
        if number == 1:
            return v.decode()
        if number in (2, 3):
            return repr(struct.unpack("<f" if number == 2 else "<d", v)[0])
        if number in (4, 5):
            return str(v - (1 << 64) if number == 4 and v >> 63 else v)
        if number == 6:
            return str((v >> 1) ^ -(v & 1))
        if number == 7:
            return "true" if v else "false"
    return ""


def _packed(raw: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def decode_tile(raw: bytes) -> Iterator[tuple[str, int, int, str, str, str]]:
    """(layer, extent, feature, geometry kind, key, value) for each tag of a vector tile; a feature without tags has a null key."""
    for number, layer in _fields(raw):
        if number != 3:
            continue
        name, extent, keys, values, features = "", 4096, [], [], []
        for n, v in _fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                features.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        for i, f in enumerate(features):
            tags, kind = [], 0
            for n, v in _fields(f):
                if n == 2:
                    tags = _packed(v)
                elif n == 3:
                    kind = v
            kind = ("unknown", "point", "line", "polygon")[kind] if kind < 4 else "unknown"
            if not tags:
                yield name, extent, i, kind, None, None
            for k, v in zip(tags[::2], tags[1::2]):
                yield name, extent, i, kind, keys[k], values[v]


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _part(number: int, body: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(body)) + body


def _typed(value: str | bool | int | float) -> bytes:
    """A value in the field of its kind: text, double, truth, or a whole number with or without a sign."""
    if isinstance(value, str):
        return _part(1, value.encode())
    if isinstance(value, float):
        return _number(3 << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, bool):
        return _number(7 << 3) + _number(value)
    return _number(5 << 3) + _number(value) if value >= 0 else _number(6 << 3) + _number(-2 * value - 1)


def encode_tile(features: list[tuple[str, int, list[tuple[str, object]]]], extent: int = 4096) -> bytes:
    """A vector tile of features (layer, geometry kind, tags), layers in the order they come first in; geometries are empty.

    A layer has each key and each value once, and features the places of theirs.
    """
    layers: dict[str, list] = {}
    for layer, kind, tags in features:
        layers.setdefault(layer, []).append((kind, tags))
    out = b""
    for name, own in layers.items():
        keys: dict[str, int] = {}
        values: dict[bytes, int] = {}
        body = _part(1, name.encode())
        for kind, tags in own:
            places = b"".join(_number(keys.setdefault(k, len(keys))) + _number(values.setdefault(_typed(v), len(values))) for k, v in tags)
            body += _part(2, (_part(2, places) if tags else b"") + _number(3 << 3) + _number(kind))
        body += b"".join(_part(3, k.encode()) for k in keys) + b"".join(_part(4, v) for v in values) + _number(5 << 3) + _number(extent) + _number(15 << 3) + _number(2)
        out += _part(3, body)
    return out


#: Tags of a feature: one of the last four is the value.
TAGS = "array<struct<key: string, text: string, whole: long, real: double, flag: boolean>>"


def vector_tiles(features: DataFrame, by: list[str], order: str) -> DataFrame:
    """``(by, tile_data)``: a tile of each group of ``features (by, order, layer, kind, tags)``; ``tags`` are of type ``TAGS``.

    A group is what one tile shows, which is bounded by what a map can draw.
    """

    @F.pandas_udf("binary")
    def encoded(column: pd.Series) -> pd.Series:
        def value(t) -> object:
            if t["whole"] is not None:
                return int(t["whole"])
            return next(v for v in (t["text"], t["flag"], t["real"]) if v is not None)

        return column.map(lambda fs: encode_tile([(f["layer"], f["kind"], [(t["key"], value(t)) for t in f["tags"]]) for f in fs]))

    # Whole numbers travel as text: pandas would make those beside nulls floating ones.
    tags = F.transform("tags", lambda t: F.struct(t["key"].alias("key"), t["text"].alias("text"), t["whole"].cast("string").alias("whole"), t["real"].alias("real"), t["flag"].alias("flag")))
    listed = features.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "layer", "kind", tags.alias("tags")))).alias("f"))
    return listed.select(*by, encoded("f").alias("tile_data"))


@udtf(returnType="layer string, extent int, feature int, geometry string, key string, value string")
class DecodeTile:
    """SQL: ``decode_tile(tile_data)``."""

    def eval(self, tile_data: bytes):
        if tile_data is not None:
            yield from decode_tile(bytes(tile_data))


def register(spark: SparkSession) -> None:
    """``decode_polyline`` and ``decode_tile`` as SQL table functions."""
    spark.udtf.register("decode_polyline", DecodePolyline)
    spark.udtf.register("decode_tile", DecodeTile)
