"""Text normalisation expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, MapType, StringType, StructType, VariantType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Labels that stand for no transcription.
JUNK = ("", ".", "-", "--", "---", "nan", "None", "null")


@F.pandas_udf(StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition, then everything outside ASCII dropped."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize(
    col: Column, *, lower: bool = True, replacements: dict[str, str] | None = None, accents: bool = False, punctuation: bool = False, whitespace: bool = True, trim: bool = True
) -> Column:
    """Lower case, replacements (case-insensitive if lowering), accents, punctuation, white space, trim, in this order."""
    if lower:
        col = F.lower(col)
    for pattern, new in (replacements or {}).items():
        col = F.regexp_replace(col, ("(?i)" if lower else "") + pattern, new)
        col = F.lower(col) if lower else col
    if accents:
        col = fold_accents(col)
    if punctuation:
        col = F.translate(col, PUNCTUATION, "")
    if whitespace:
        col = F.regexp_replace(col, r"(?U)\s+", " ")
    return F.trim(col) if trim else col


#: What stands before a separator of JSON text: whole strings, and other characters.
_BEFORE = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])'


def raw_label(col: Column, kind: DataType) -> Column:
    """A label of any type as text: bytes as UTF-8 with replacements, nested values and variants as JSON with sorted
    keys and a space after separators, other values as they print; null as empty."""
    if isinstance(kind, BinaryType):
        text = F.make_valid_utf8(col.cast("string"))
    elif isinstance(kind, (StructType, ArrayType, MapType, VariantType)):
        # a variant keeps the keys of an object in order
        value = col if isinstance(kind, VariantType) else F.parse_json(F.to_json(col, {"ignoreNullFields": "false"}))
        text = F.regexp_replace(F.to_json(value), _BEFORE, "$1$2 ")
    elif isinstance(kind, BooleanType):
        text = F.when(col, "True").otherwise("False")
    else:
        text = col.cast("string")
    return F.when(col.isNotNull(), text).otherwise("")


def clean_label(col: Column) -> Column:
    """A raw label as text: bars are spaces, white space collapses, junk labels are empty."""
    text = collapse(F.replace(F.coalesce(col, F.lit("")), F.lit("|"), F.lit(" ")))
    return F.when(text.isin(*JUNK), F.lit("")).otherwise(text)


def word_key(col: Column) -> Column:
    """Trimmed and lower-cased, without characters other than letters and digits of any script, underscore,
    hyphen and white space; null stays null."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{N}_\s-]", "")


def key_words(col: Column) -> Column:
    """The words of a text's key; a single empty one for a text without any."""
    return F.split(word_key(col), r"\s+")


def name_words(col: Column) -> Column:
    """The runs of letters, digits and underscore of a lower-cased text: names stand between their borders."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(col: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")
