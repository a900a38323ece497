"""Vocabulary catalogues as lexicon entries: nested medications, directions for use, names of clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import word_key

# Weights of the kinds of entries.
GENERIC, BRAND, LASA, DIRECTION, CLIENT = 2.0, 1.5, 0.5, 3.0, 4.0
_ENTRY = ["word", "weight", "metadata"]


def _entries(rows: DataFrame, word: Column, weight: Column, kind: str, **more: Column) -> DataFrame:
    pairs = [F.lit("type"), F.lit(kind), *[x for k, v in more.items() for x in (F.lit(k), v)]]
    return rows.select(F.trim(word).alias("word"), weight.cast("double").alias("weight"), F.create_map(*pairs).alias("metadata"))


def read_medications(spark: SparkSession, path: str) -> DataFrame:
    """Generic and brand names of a catalogue ``{medications: [{generic_name, is_lasa, brand_names}]}``."""
    schema = "medications array<struct<generic_name:string,is_lasa:boolean,brand_names:array<string>>>"
    meds = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("medications")).filter("generic_name <> ''")
    lasa = F.coalesce("is_lasa", F.lit(False))
    generic = _entries(meds, F.col("generic_name"), GENERIC + F.when(lasa, LASA).otherwise(0.0), "medication_generic", is_lasa=lasa.cast("string"))
    brands = meds.select("generic_name", F.explode("brand_names").alias("brand"))
    return generic.union(_entries(brands, F.col("brand"), F.lit(BRAND), "medication_brand", generic=F.col("generic_name")))


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a catalogue ``{codes: [{code, meaning}]}``."""
    codes = spark.read.schema("codes array<struct<code:string,meaning:string>>").option("multiLine", True).json(path).select(F.inline("codes"))
    return _entries(codes.filter("code <> ''"), F.col("code"), F.lit(DIRECTION), "direction", meaning=F.coalesce("meaning", F.lit("")))


def read_clients(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Names of ``{entities: [{name, confidence_prior}]}`` or ``{names: [...]}``, or of text lines without
    comments with ``form="text"``."""
    if form == "text":
        names = spark.read.text(path).select(F.trim("value").alias("name"), F.lit(None).cast("double").alias("prior")).filter("name <> '' and not startswith(name, '#')")
    else:
        raw = spark.read.schema("entities array<struct<name:string,confidence_prior:double>>, names array<string>").option("multiLine", True).json(path)
        some = F.coalesce(F.size("entities") > 0, F.lit(False))
        plain = F.transform("names", lambda n: F.struct(n.alias("name"), F.lit(None).cast("double").alias("confidence_prior")))
        names = raw.select(F.inline(F.when(some, F.col("entities")).otherwise(plain))).toDF("name", "prior").filter("trim(name) <> ''")
    return _entries(names, F.col("name"), F.coalesce("prior", F.lit(CLIENT)), "client")


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """One entry a key over catalogues in load order: the first word, the largest weight, and metadata of
    all, of which later catalogues' values hold: key, word, weight, metadata. Words without a key
    are left out; of one catalogue's words of a key the smallest is first."""
    every = None
    for k, c in enumerate(catalogs):
        part = c.select(F.lit(k).alias("load_order"), *_ENTRY)
        every = part if every is None else every.unionByName(part)
    keyed = every.withColumn("key", word_key(F.col("word"))).filter("key <> ''")
    cells = F.sort_array(F.collect_set(F.struct("load_order", "word", F.to_json("metadata").alias("m"))))  # a key's entries: few
    merged = F.aggregate(
        "cells", F.create_map().cast("map<string,string>"),
        lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(F.from_json(x["m"], "map<string,string>"), k)), F.from_json(x["m"], "map<string,string>")),
    )
    out = keyed.groupBy("key").agg(F.min_by("word", F.struct("load_order", "word")).alias("word"), F.max("weight").alias("weight"), cells.alias("cells"))
    return out.select("key", "word", "weight", merged.alias("metadata"))
