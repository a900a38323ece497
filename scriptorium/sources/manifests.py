"""Sample manifests as JSON lines, one JSON document, or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Read as text, whatever their JSON type: nested ones keep their JSON.
FIELDS = ["sample_id", "id", "image_path", "image", "full_text", "text", "category", "writer_id", "items", "medications", "metadata", "is_lasa", "therapeutic_class", "source",
          "dataset_source", "split", "transcription", "clinic_name", "clinic", "doctor_name", "doctor", "patient_name", "patient", "date"]
#: Keys of a record that override those of its metadata.
OVERRIDES = ["category", "is_lasa", "therapeutic_class", "writer_id", "source", "dataset_source", "split", "text", "transcription"]
ITEM = ["medication", "dosage", "sig", "dispense", "refills"]
_OTHER = {"medication": "name", "dosage": "strength", "sig": "instructions", "dispense": "disp"}
_DEFAULTS = {"dispense": "#30", "refills": "0"}
_RECORD = ", ".join(f"{c} string" for c in FIELDS)


def first_of(*names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def _item(raw: Column) -> Column:
    """An item from its JSON: an object with either name of a field, or a list of three places or more."""
    fields = F.from_json(raw, ", ".join(f"{c} string" for c in [*ITEM, *_OTHER.values()]))
    named = [F.coalesce(fields[c], *[fields[n] for n in [_OTHER.get(c)] if n], F.lit("0" if c == "refills" else "")).alias(c) for c in ITEM]
    places = F.from_json(raw, "array<string>")
    placed = [F.coalesce(F.get(places, F.lit(k)), F.lit(_DEFAULTS.get(c, ""))).alias(c) for k, c in enumerate(ITEM)]
    return F.when(raw.startswith("{"), F.struct(*named)).when(raw.startswith("[") & (F.size(places) >= 3), F.struct(*placed))


def conform_manifest(raw: DataFrame) -> DataFrame:
    """sample_id, image_path, full_text, writer_id, items, metadata and people of ``raw``, records with
    the columns ``FIELDS`` as text.

    Aliases are resolved; a missing text is rebuilt from the items and stays as it is where there are none; a record's own fields override its
    metadata, whose other category is kept as template_category. Synthetic rows are left out. An
    item that is neither an object nor a list of three is left out; a null id stays null.
    """
    listed = F.coalesce(F.from_json(F.coalesce("items", "medications"), "array<string>"), F.array().cast("array<string>"))
    items = F.filter(F.transform(listed, _item), lambda x: x.isNotNull())
    text = lambda x: F.concat(x["medication"], F.lit(" "), x["dosage"], F.lit("\nSig: "), x["sig"], F.lit("\nDisp: "), x["dispense"], F.lit(" Refills: "), x["refills"])
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.map_filter(F.create_map(*[x for c in OVERRIDES for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    was = F.col("meta")["category"]
    other = F.when(was != F.col("category"), F.create_map(F.lit("template_category"), was)).otherwise(F.create_map().cast("map<string,string>"))
    rows = raw.withColumns({"items": items, "meta": meta})
    names = [F.coalesce(f"{who}_name", who, F.lit("")).alias(f"{who}_name") for who in ("clinic", "doctor", "patient")]
    merged = F.map_concat(F.map_filter("meta", lambda k, _: ~F.array_contains(F.map_keys("own"), k) & (k != "template_category")), F.col("own"), F.when(F.map_contains_key("other", "template_category"), F.col("other")).otherwise(F.map_filter("meta", lambda k, _: k == "template_category")))
    out = rows.withColumns({"own": own, "other": other}).select(
        first_of("sample_id", "id").alias("sample_id"), first_of("image_path", "image").alias("image_path"),
        F.coalesce(first_of("full_text", "text"), F.when(F.size("items") > 0, F.array_join(F.transform("items", text), "\n")), "full_text", "text").alias("full_text"), "writer_id", "items", merged.alias("metadata"),
        *names, F.coalesce("date", F.lit("")).alias("date"),
    )
    return out.filter(~F.coalesce(F.endswith("image_path", F.lit("_syn.png")), F.lit(False)))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False, form: str = "json") -> DataFrame:
    """A manifest as JSON lines; as one JSON document a file with ``multi_line``: a list of records, an
    object that holds them under ``samples``, or a single record; or as ``form="csv"`` with a header."""
    if form == "csv":
        raw = spark.read.options(header=True, multiLine=multi_line, escape='"').csv(path)
        lacking = {c: F.lit(None).cast("string") for c in FIELDS if c not in raw.columns}
        return conform_manifest(raw.withColumns(lacking).select(*FIELDS).fillna("", "text"))  # a cell that is blank is an empty text
    raw = spark.read.schema(f"{_RECORD}, samples string").option("multiLine", multi_line).json(path)
    inside = raw.filter("samples is not null").select(F.explode(F.from_json("samples", f"array<struct<{_RECORD.replace(' string', ':string')}>>")).alias("r")).select("r.*")
    return conform_manifest(raw.filter("samples is null").select(*FIELDS).unionByName(inside))
