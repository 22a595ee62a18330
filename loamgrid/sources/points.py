"""Delimited point files."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from loamgrid.functions.geometry import let
from loamgrid.functions.scalar import parse_float, parse_float_once, trim_all
from loamgrid.sources.ranges import quoted_records

# Delimiters in tie order and accepted column names.
DELIMITERS = [",", ";", "\t", "|"]
LAT_NAMES = ["latitude", "lat", "y", "y_coord", "ycoord", "lat_dd", "latitude_dd"]
LON_NAMES = ["longitude", "long", "lon", "lng", "x", "x_coord", "xcoord", "lon_dd", "longitude_dd"]
COMBINED_NAMES = ["coordinates", "coordinate", "coords", "coord", "latlon", "latlng", "lonlat"]
LIKELY_NAMES = ["location", "point", "position", "geo"]


def sanitize_header(names: list[str]) -> list[str]:
    """Byte-order mark off, trimmed, lower case, blanks to ``_``; blank -> ``column_N``; unique."""
    out: list[str] = []
    for i, name in enumerate(names):
        blank = re.fullmatch(rf"_c{i}", name or "") is not None
        text = "" if blank else re.sub(r"\s+", "_", (name or "").lstrip("﻿").strip().lower())
        text = text or f"column_{i + 1}"
        while text in out:
            text += "_"
        out.append(text)
    return out


def pick_delimiter(line: str) -> str:
    """The most frequent candidate outside quotes; first candidate on ties; comma if none."""
    bare = re.sub(r'"(?:[^"]|"")*"?', "", line)
    counts = [bare.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))]


def detect_delimiter(spark: SparkSession, path) -> str:
    """Reads one non-blank line."""
    lines = spark.read.text(path).filter(F.trim("value") != "").limit(1).take(1)
    return pick_delimiter(lines[0]["value"]) if lines else ","


def split_pair(c) -> Column:
    """Two numbers parted by blanks, comma or slash -> struct(lat, lon), else null."""
    parts = F.filter(F.split(trim_all(c), r"[\s,/]+"), lambda p: p != "")
    pair = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))

    def placed(numbers: Column) -> Column:
        a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        first = (F.abs(a) <= 90) & (F.abs(b) <= 180)
        second = (F.abs(b) <= 90) & (F.abs(a) <= 180)
        return F.when(first, pair(a, b)).when(second, pair(b, a))

    return let(parts, lambda p: F.when(F.size(p) == 2, let(F.transform(p, parse_float_once), placed)))


def coordinate_columns(df: DataFrame, probe: bool = True) -> dict[str, str]:
    """``{"lat", "lon"}``, or ``{"combined"}``.

    A combined column is accepted when a value of it parses; the probe reads
    rows only until one is found.
    """
    lat = next((c for c in df.columns if c in LAT_NAMES), None)
    lon = next((c for c in df.columns if c in LON_NAMES), None)
    if lat and lon:
        return {"lat": lat, "lon": lon}
    candidates = [c for tier in (COMBINED_NAMES, LIKELY_NAMES) for c in df.columns if c in tier]
    for c in candidates:
        if not probe or df.filter(split_pair(F.col(f"`{c}`")).isNotNull()).limit(1).take(1):
            return {"combined": c}
    if candidates:
        return {"combined": candidates[0]}
    raise ValueError("need latitude and longitude columns, or one combined coordinates column")


def triage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``status`` (point / skipped / invalid), ``lat`` and ``lon``; drop the source coordinates."""
    if "combined" in columns:
        raw = F.col(f"`{columns['combined']}`")
        df = df.withColumn("_pair", split_pair(raw))
        lat, lon = F.col("_pair.lat"), F.col("_pair.lon")
        blank = F.coalesce(trim_all(raw), F.lit("")) == ""
        used = [columns["combined"], "_pair"]
    else:
        a, b = F.col(f"`{columns['lat']}`"), F.col(f"`{columns['lon']}`")
        lat, lon = parse_float(a), parse_float(b)
        blank = (F.coalesce(trim_all(a), F.lit("")) == "") & (F.coalesce(trim_all(b), F.lit("")) == "")
        used = [columns["lat"], columns["lon"]]
    status = F.when(blank, "skipped").when(lat.isNull() | lon.isNull(), "invalid").otherwise("point")
    named = df.withColumns({"_status": status, "_lat": lat, "_lon": lon}).drop(*used)
    return named.withColumnsRenamed({"_status": "status", "_lat": "lat", "_lon": "lon"})


def read_delimited(spark: SparkSession, path, delimiter: str | None = None, multiline: bool = True) -> DataFrame:
    """Text columns with sanitised names; rows with nothing in them are dropped.

    Files are split over tasks, line breaks inside quotes or not (:mod:`loamgrid.sources.ranges`); an unmatched quote is an
    error.  ``multiline=False`` leaves out the two passes that this takes, for files whose values hold no line break.
    """
    sep = delimiter or detect_delimiter(spark, path)
    if multiline:
        records = quoted_records(spark, path)
        head = records.where("first").select("record").orderBy("file").limit(1).take(1)
        names = next(csv.reader([head[0].record.lstrip("\ufeff")], delimiter=sep), [""]) if head else []
        if not names:
            return spark.createDataFrame([], StructType())
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        options = {"sep": sep, "quote": '"', "escape": '"'}
        raw = records.where("NOT first AND record <> ''").select(F.from_csv("record", schema, options).alias("r")).select("r.*")
        df = raw.toDF(*sanitize_header(names))
    else:
        raw = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
        df = raw.toDF(*sanitize_header(raw.columns))
    text = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return text.filter(reduce(lambda a, b: a | b, [trim_all(F.col(f"`{c}`")) != "" for c in text.columns]))


def read_points_csv(spark: SparkSession, path, delimiter: str | None = None, multiline: bool = True) -> DataFrame:
    """Triaged points; attributes stay text."""
    df = read_delimited(spark, path, delimiter, multiline)
    return triage(df, coordinate_columns(df))
