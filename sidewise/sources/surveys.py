"""Survey tables: values of variables by respondent, and what is known about each variable."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of measurement levels.
TYPES: dict[str, tuple[str, ...]] = {
    "numeric": ("numeric", "scale", "interval", "ratio", "continuous"),
    "ordinal": ("ordinal", "ordered"),
    "nominal": ("nominal", "categorical", "unordered"),
}


def type_name(kind: str | None) -> str | None:
    """The standard name of a measurement level; None for an unknown one."""
    return next((k for k, names in TYPES.items() if (kind or "").lower() in names), None)


@dataclass(frozen=True)
class Variable:
    name: str
    type: str | None = None
    label: str = ""
    valid: Mapping[Any, str] = field(default_factory=dict)
    invalid: Mapping[Any, str] = field(default_factory=dict)
    usable: bool = True

    def sorted(self) -> Variable:
        by = lambda m: dict(sorted(m.items(), key=lambda kv: (isinstance(kv[0], str), kv[0])))
        return replace(self, valid=by(self.valid), invalid=by(self.invalid))

    def add_values(self, valid: Mapping[Any, str] | None = None, invalid: Mapping[Any, str] | None = None) -> Variable:
        """More values; labels that exist win; a value is on one list only."""
        v = {**(valid or {}), **self.valid}
        i = {k: x for k, x in {**(invalid or {}), **self.invalid}.items() if k not in v}
        return replace(self, valid=v, invalid=i).sorted()

    def set_values(self, valid: Mapping[Any, str] | None = None, invalid: Mapping[Any, str] | None = None) -> Variable:
        """Lists in place of those there are; a value is on one list only."""
        v = dict(self.valid if valid is None else valid)
        i = {k: x for k, x in (self.invalid if invalid is None else invalid).items() if k not in v}
        return replace(self, valid=v, invalid=i).sorted()

    def replace_values(self, mapping: Mapping[Any, Any], combine_labels: bool = True) -> Variable:
        """Values under other names; labels of values that become one are joined, or the first
        stays."""

        def merge(values: Mapping[Any, str]) -> dict[Any, str]:
            out: dict[Any, str] = {}
            for x, label in values.items():
                y = mapping.get(x, x)
                out[y] = f"{out[y]} | {label}" if y in out and combine_labels else out.get(y, label)
            return out

        return replace(self, valid=merge(self.valid), invalid=merge(self.invalid)).sorted()

    def with_labels(self, labels: Mapping[Any, str]) -> Variable:
        new = lambda m: {k: labels.get(k, x) for k, x in m.items()}
        return replace(self, valid=new(self.valid), invalid=new(self.invalid))

    def all_values(self) -> list[Any]:
        return [*self.valid, *self.invalid]

    def allows(self, op: str) -> bool:
        """Whether a constraint with this operator makes sense for the measurement level."""
        kind = type_name(self.type)
        return op in ("==", "!=") or op in ("<", "<=", ">", ">=") and kind in ("ordinal", "numeric") or op in ("in", "not in") and kind == "numeric"

    def row(self) -> tuple:
        """Name, type, label and both lists as JSON."""
        text = lambda m: json.dumps({str(k): v for k, v in m.items()})
        return (self.name, self.type, self.label, text(self.valid), text(self.invalid))


def resolve(columns: Sequence[str], selection: Any = None, variables: Mapping[str, Variable] | None = None) -> list[str]:
    """Columns by None (all), position, name, slice, list of these, mask, or a function of the
    variable."""
    columns = list(columns)
    if selection is None:
        return columns
    if isinstance(selection, str):
        if selection not in columns:
            raise KeyError(selection)
        return [selection]
    if isinstance(selection, bool):
        raise TypeError("a single truth value selects nothing")
    if isinstance(selection, int):
        return [columns[selection]]
    if isinstance(selection, slice):
        return columns[selection]
    if callable(selection):
        return [c for c in columns if selection((variables or {}).get(c, Variable(c)))]
    items = list(selection)
    if items and all(isinstance(x, bool) for x in items):
        if len(items) != len(columns):
            raise ValueError(f"{len(items)} marks for {len(columns)} columns")
        return [c for c, on in zip(columns, items, strict=True) if on]
    return [c for x in items for c in resolve(columns, x, variables)]


def sentinel_for(df: DataFrame, col: str, variable: Variable) -> Any:
    """A value no answer has: below the least for numbers, a free name for strings."""
    if isinstance(df.schema[col].dataType, T.StringType):
        taken = {r[0] for r in df.where(F.col(col).startswith("NaN")).select(col).distinct().collect()} | set(variable.invalid)
        return next(x for x in ("NaN", *(f"NaN_{k}" for k in range(1, len(taken) + 2))) if x not in taken)
    least = df.agg(F.min(F.when(~F.isnan(F.col(col).cast("double")), F.col(col)))).first()[0]
    return min(least if least is not None else 0, min(variable.invalid, default=0), 0) - 1


def load(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, dict[str, Variable]]:
    """``{name}_data.csv`` and ``{name}_varinfo.csv`` with values and labels as JSON."""
    data = spark.read.csv(f"{folder}/{name}_data.csv", header=True, inferSchema=True, escape='"')
    rows = spark.read.csv(f"{folder}/{name}_varinfo.csv", header=True, escape='"').collect()
    out = {}
    for r in rows:
        kind = data.schema[r["name"]].dataType if r["name"] in data.columns else T.StringType()
        cast = (int if isinstance(kind, T.IntegralType) else float) if isinstance(kind, T.NumericType) else str
        values = lambda text, cast=cast: {cast(k): v for k, v in json.loads(text or "{}").items()}
        out[r["name"]] = Variable(r["name"], r["type"], r["label"] or "", values(r["valid_values"]), values(r["invalid_values"]))
    return data, out


def save(data: DataFrame, variables: Mapping[str, Variable], folder: str, name: str, single: bool = False) -> None:
    """The same as two folders of CSV parts; ``single``: the data as one part, for small surveys."""
    data = data.coalesce(1) if single else data
    data.write.mode("overwrite").csv(f"{folder}/{name}_data.csv", header=True, escape='"')
    rows = [v.row() for v in variables.values()]
    info = data.sparkSession.createDataFrame(rows, "name string, type string, label string, valid_values string, invalid_values string")
    info.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}_varinfo.csv", header=True, escape='"')


def from_labelled_file(
    names: Sequence[str], labels: Mapping[str, str], measures: Mapping[str, str], values: Mapping[str, Mapping[Any, str]],
    missing: Mapping[str, Sequence[tuple[float, float]]],
) -> dict[str, Variable]:
    """Variables from a statistics file's description: measures "scale" are numeric, values
    inside a range of missing ones invalid."""
    out = {}
    for n in names:
        gone = lambda v, n=n: any(isinstance(v, int | float) and lo <= v <= hi for lo, hi in missing.get(n, ()))
        listed = values.get(n, {})
        out[n] = Variable(
            n, type_name(measures.get(n)), labels.get(n) or "", {k: x for k, x in listed.items() if not gone(k)}, {k: x for k, x in listed.items() if gone(k)}
        ).sorted()
    return out


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Raw image files: path, time, length and content."""
    return spark.read.format("binaryFile").load(path)


#: Samples of a pixel by colour type: grey, RGB, palette, grey and alpha, RGB and alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels ``rows x columns x samples`` of a PNG with 8 bits a sample that isn't interlaced;
    palettes are looked up."""
    if raw[:8] != bytes([137, 80, 78, 71, 13, 10, 26, 10]):
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, b""
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    if head[8] != 8 or head[12] != 0:
        raise ValueError("only 8 bits a sample, not interlaced")
    n = _SAMPLES[head[9]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.int64)  # a line above and a pixel to the left are 0
    for r in range(height):
        rule, line = int(lines[r, 0]), lines[r, 1:].reshape(width, n).astype(np.int64)
        above, own = out[r], out[r + 1]
        if rule in (0, 2):
            own[1:] = (line + (above[1:] if rule else 0)) % 256
            continue
        for c in range(1, width + 1):
            left, up, corner = own[c - 1], above[c], above[c - 1]
            if rule == 1:
                guess = left
            elif rule == 3:
                guess = (left + up) // 2
            else:  # the neighbour nearest to left + up - corner
                near = [np.abs(x - (left + up - corner)) for x in (left, up, corner)]
                guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
            own[c] = (line[c - 1] + guess) % 256
    pixels = out[1:, 1:].astype(np.uint8)
    return palette[pixels[:, :, 0]] if head[9] == 3 else pixels


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``path, pixel_id, row, col, samples array<int>`` of PNG files; an image is decoded in one
    task, pixels are numbered by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = decode_png(raw)
                h, w, n = pixels.shape
                place = np.arange(h * w)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * n), pa.array(pixels.ravel().astype(np.int32)))
                columns = [pa.array([name] * (h * w)), pa.array(place), pa.array((place // w).astype(np.int32)), pa.array((place % w).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "pixel_id", "row", "col", "samples"])

    return read_images(spark, path).select("path", "content").mapInArrow(run, "path string, pixel_id long, row int, col int, samples array<int>")
