"""Sources: tables, page JSON, CSV, dictionaries, hOCR, shapes."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = "page_id string, section_id string, volume int, source_id string, source_page_key string, layer string, text string, original_text string, margin_notes array<struct<text:string,side:string>>, footnotes string, ocr_source string, printed_page string"
REQUIRED = ("page_id", "section_id", "volume", "source_id", "source_page_key", "layer", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_pages(pages: DataFrame, layer: str = "primary_text") -> DataFrame:
    """``pages``, failing if a required field is null, a layer is another one, or an id repeats.

    One aggregate looks for all faults; it is joined as one row, so that the check
    runs with the query and not before it.
    """
    missing = F.greatest(*(F.max(F.col(c).isNull().cast("int")) for c in REQUIRED))
    other = F.max((F.col("layer") != layer).cast("int"))
    twice = pages.groupBy("page_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    faults = pages.agg(F.coalesce(missing, F.lit(0)).alias("missing"), F.coalesce(other, F.lit(0)).alias("other"))
    why = F.when(F.col("missing") == 1, "a required field is missing").when(F.col("other") == 1, f"a layer is not {layer}").when(F.col("most") > 1, "a page_id repeats")
    verdict = faults.join(F.broadcast(twice), F.expr("most >= 0")).select(F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(True).alias("_ok"))
    return pages.join(F.broadcast(verdict), F.col("_ok")).drop("_ok")


def read_pages(spark: SparkSession, path: str, layer: str = "primary_text") -> DataFrame:
    """A JSON array of page objects, in a declared schema; ``ord`` is the order within the volume by id."""
    pages = spark.read.schema(PAGES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    from pyspark.sql import Window

    return checked_pages(pages, layer).withColumn("ord", F.row_number().over(Window.partitionBy("volume").orderBy("page_id")).cast("long"))


def read_csv(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, all columns strings, empty for missing; a byte order mark before the header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in fields or df.columns))


PERSON = "struct<aliases:array<string>,source:string,basis:string,name_groups:array<string>,extra_aliases:array<string>,skip_aliases:array<string>>"


def read_dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A person dictionary as three tables: people, excluded (name, reason), contextual (form, volume, person, basis)."""
    schema = f"people map<string,{PERSON}>, excluded map<string,string>, contextual_aliases array<struct<forms:array<string>,by_volume:map<string,string>,basis:string>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path)
    one = one.select(F.when(F.col("people").isNull(), F.raise_error(F.lit("people is missing")).cast(f"map<string,{PERSON}>")).otherwise(F.col("people")).alias("people"), "excluded", "contextual_aliases")
    people = one.select(F.explode("people").alias("person", "p")).select("person", "p.*")
    excluded = one.select(F.explode("excluded").alias("name", "reason"))
    rules = one.select(F.posexplode("contextual_aliases").alias("ord", "c"))
    rules = rules.select("ord", F.explode("c.forms").alias("form"), "c.by_volume", "c.basis").select("ord", "form", "basis", F.explode("by_volume").alias("volume", "person"))
    return {"people": people, "excluded": excluded, "contextual": rules.withColumn("volume", F.col("volume").cast("int"))}


def aliases(people: DataFrame) -> DataFrame:
    """person, alias: one row per alias, extra ones included, skipped ones left out."""
    every = F.array_except(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("extra_aliases", F.array().cast("array<string>"))), F.coalesce("skip_aliases", F.array().cast("array<string>")))
    return people.select("person", F.explode(every).alias("alias"))


def split_aliases(places: DataFrame, column: str = "aliases") -> DataFrame:
    """Aliases in one string, split at |, trimmed, blanks dropped: an array."""
    return places.withColumn(column, F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"), lambda x: F.btrim(x)), lambda x: x != ""))


def place_phrases(places: DataFrame) -> DataFrame:
    """phrase -> the places (place_id, preferred_name, matching_policy) that go by it."""
    from inkwell.functions.text import normalized_phrase

    names = places.select("place_id", "preferred_name", "matching_policy", F.explode(F.array_union(F.array("preferred_name"), "aliases")).alias("name"))
    rows = names.withColumn("phrase", normalized_phrase(F.col("name"))).filter("phrase <> ''")
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set(F.struct("place_id", "preferred_name", "matching_policy"))).alias("places"))


def hocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """leaf, html: the pages of hOCR files; a page's number is its ppageno, else its place in the file."""
    files = spark.read.option("wholetext", True).text(path)
    parts = F.filter(F.split("value", r"(?=<div[^>]*class=['\"]ocr_page['\"])"), lambda x: F.contains(x, F.lit("ocr_page")))
    pages = files.select(F.posexplode(parts).alias("i", "html"))
    return pages.select(F.coalesce(F.nullif(F.regexp_extract("html", r"ppageno\s+(\d+)", 1), F.lit("")).cast("int"), F.col("i")).alias("leaf"), "html")


RINGS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def shape_rings(data: bytes) -> Iterator[list[tuple[float, float]]]:
    """Rings of the polygons of a shapefile: records after a header of 100 bytes, parts as point offsets."""
    view, at = memoryview(data), 100
    while at + 8 <= len(view):
        (words,) = struct.unpack_from(">i", view, at + 4)
        body = view[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack_from("<i", body)[0] != 5:
            continue
        parts, points = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        pairs = list(zip(flat[::2], flat[1::2], strict=True))
        yield from (pairs[a:b] for a, b in zip(starts, starts[1:], strict=False))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, i, ring of each polygon ring in shapefiles."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, i, [{"lon": x, "lat": y} for x, y in ring]) for p, c in zip(part["path"], part["content"], strict=True) for i, ring in enumerate(shape_rings(c))]
            yield pd.DataFrame(rows, columns=["path", "i", "ring"])

    return files.mapInPandas(parse, "path string, i int, ring array<struct<lon:double,lat:double>>")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature, ring of the polygons and multipolygons of GeoJSON files."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    g = f.select("feature", F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", many)).otherwise(F.array(F.from_json("f.geometry.coordinates", one))).alias("p"))
    rings = g.select("feature", F.explode(F.flatten("p")).alias("r"))
    return rings.select("feature", F.transform("r", lambda q: F.struct(F.get(q, F.lit(0)).alias("lon"), F.get(q, F.lit(1)).alias("lat"))).alias("ring"))
