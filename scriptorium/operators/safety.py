"""Safety audits of confusable names, identifier checks, catalogue checks, and the release decision."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import key_words, name_words


#: Names of a catalogue that go to all tasks as one automaton; a larger catalogue is joined by first words.
AUTOMATON_NAMES = 50_000
_COUNTS = "array<struct<name:string,ref:int,hyp:int>>"


def _by_automaton(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``counts`` by one pass of an Aho-Corasick automaton over each text's words."""

    def count(found: dict, automaton, text: str | None, side: int) -> None:
        last: dict[str, int] = {}
        for end, name in automaton.iter(f" {text or ''} "):
            start = end - len(name)
            if start >= last.get(name, 0):  # those of one name do not overlap
                last[name] = end
                found.setdefault(name, [0, 0])[side] += 1

    @F.pandas_udf(_COUNTS)
    def counts(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(f" {name} ", name)
        automaton.make_automaton()
        for refs, hyps in frames:
            out = []
            for ref, hyp in zip(refs, hyps, strict=True):
                found: dict[str, list[int]] = {}
                count(found, automaton, ref, 0)
                count(found, automaton, hyp, 1)
                out.append([{"name": n, "ref": r, "hyp": h} for n, (r, h) in sorted(found.items())])
            yield pd.Series(out)

    text = lambda c: F.array_join(name_words(F.col(c)), " ")
    return rows.withColumn("counts", counts(text("ref"), text("hyp")) if names else F.array().cast(_COUNTS))


def _by_first_word(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The same by an equi-join of words with the first words of names, for catalogues of any size."""
    names = names.select("name", F.split("name", " ").alias("parts")).withColumn("word", F.get("parts", F.lit(0)))
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    sides = keyed.select("row", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), name_words(F.col(c)).alias("w")) for k, c in enumerate(("ref", "hyp"))])).alias("s"))
    placed = sides.select("row", "s.side", "s.w", F.posexplode("s.w").alias("pos", "word"))
    hits = placed.join(names, "word").filter(F.slice("w", F.col("pos") + 1, F.size("parts")) == F.col("parts"))
    grouped = hits.groupBy("row", "side", "name").agg(F.array_sort(F.collect_list("pos")).alias("at"), F.first(F.size("parts")).alias("size"))
    taken = lambda a, p: F.when(p >= a["next"], F.struct((a["n"] + 1).alias("n"), (p + F.col("size")).alias("next"))).otherwise(a)
    grouped = grouped.withColumn("n", F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("next")), taken)["n"])
    sums = grouped.groupBy("row", "name").agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).cast("int").alias(c) for k, c in enumerate(("ref", "hyp"))])
    listed = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("name", "ref", "hyp"))).alias("counts"))
    return keyed.join(listed, "row", "left").withColumn("counts", F.coalesce("counts", F.array().cast(_COUNTS))).drop("row")


def name_counts(rows: DataFrame, names: DataFrame, most: int = AUTOMATON_NAMES) -> DataFrame:
    """``rows(ref, hyp, ...)`` with ``counts``: for each name that stands in a row, how often it does on either
    side. Names are those of ``names(name)``, of one word or several, whatever their case and what stands between
    their words; they match at word borders, and one name's matches do not overlap. Null texts hold none.

    A catalogue of up to ``most`` names is measured first and then sent to all tasks.
    """
    known = names.select(F.array_join(name_words(F.col("name")), " ").alias("name")).filter("name <> ''").distinct()
    few = known.limit(most + 1).collect()
    return _by_automaton(rows, [r.name for r in few]) if len(few) <= most else _by_first_word(rows, known)


def lasa_audit(rows: DataFrame, pairs: DataFrame, keep: tuple[str, ...] = (), most: int = AUTOMATON_NAMES) -> DataFrame:
    """Rows in which one name of a pair stands for the other: doc_id, line_no, expected, found, rule, and the
    columns ``keep``.

    ``substituted``: the reference has one name and not the other, which the hypothesis has. ``multiple``: the
    reference has both, and in the hypothesis the one is rarer and the other more frequent. Names as in ``name_counts``.
    """
    clean = lambda c: F.array_join(name_words(F.col(c)), " ")
    both = pairs.select(clean("drug_a").alias("a"), clean("drug_b").alias("b")).filter("a <> '' and b <> '' and a <> b")
    directed = both.union(both.select("b", "a")).distinct()
    counted = name_counts(rows.select("doc_id", "line_no", *keep, "ref", "hyp"), directed.select(F.col("a").alias("name")), most).filter(F.size("counts") > 0)
    hit = counted.select("doc_id", "line_no", *keep, "counts", F.explode("counts").alias("x")).filter("x.ref > 0")
    hit = hit.withColumn("a", F.col("x.name")).join(directed, "a")
    of = F.get(F.filter("counts", lambda c: c["name"] == F.col("b")), F.lit(0))
    seen = lambda side: F.coalesce(of[side], F.lit(0))
    rule = F.when((seen("ref") == 0) & (seen("hyp") > 0), "substituted").when((seen("ref") > 0) & (F.col("x.hyp") < F.col("x.ref")) & (seen("hyp") > seen("ref")), "multiple")
    return hit.withColumn("rule", rule).filter("rule is not null").select("doc_id", "line_no", *keep, F.col("a").alias("expected"), F.col("b").alias("found"), "rule")


def lasa_near_miss(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first hypothesis word within two edits of the other name, and nearer to it than to the
    expected one, where neither side has that name itself."""
    both = pairs.select(F.col("drug_a").alias("a"), F.col("drug_b").alias("b"))
    directed = both.union(both.select("b", "a")).distinct()
    words = rows.select("doc_id", "line_no", key_words(F.col("ref")).alias("rw"), key_words(F.col("hyp")).alias("hw"))
    hit = words.select("*", F.explode(F.array_distinct("rw")).alias("a")).join(directed, "a")
    hit = hit.filter(~F.array_contains("rw", F.col("b")) & ~F.array_contains("hw", F.col("b")))
    tried = hit.select("doc_id", "line_no", "a", "b", F.posexplode("hw").alias("pos", "tok"))
    d = F.levenshtein("tok", "b", 2)
    near = tried.filter((d >= 1) & (d < F.levenshtein("tok", "a")))
    return near.groupBy("doc_id", "line_no", F.col("a").alias("expected"), F.col("b").alias("near")).agg(F.min_by("tok", "pos").alias("token"))


def lasa_coverage(rows: DataFrame, pairs: DataFrame, most: int = AUTOMATON_NAMES) -> DataFrame:
    """Of both directions of all pairs, how many some reference shows, with one name and without the other.
    Names as in ``name_counts``."""
    clean = lambda c: F.array_join(name_words(F.col(c)), " ")
    both = pairs.select(clean("drug_a").alias("a"), clean("drug_b").alias("b"))
    directed = both.union(both.select("b", "a")).distinct()
    counted = name_counts(rows.select("ref", F.lit("").alias("hyp")), directed.select(F.col("a").alias("name")), most)
    named = counted.select(F.col("counts.name").alias("w")).filter(F.size("w") > 0)
    shown = named.select("w", F.explode("w").alias("a")).join(directed, "a").filter(~F.array_contains("w", F.col("b"))).select("a", "b").distinct()
    return directed.join(shown.withColumn("s", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("directions"), F.count("s").alias("covered"))


def npi_valid(npi: Column) -> Column:
    """Luhn check of ten digits behind the prefix 80840."""
    digits = F.transform(F.split(F.concat(F.lit("80840"), npi), ""), lambda c: c.try_cast("int"))
    # the prefix makes fifteen digits: every second one from the right, the even places, is doubled
    twice = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return npi.rlike("^[0-9]{10}$") & (F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0)


def dea_valid(dea: Column) -> Column:
    d = lambda k: F.substring(dea, k + 2, 1).try_cast("int")
    return F.coalesce(dea.rlike("^[ABFM][A-Z][0-9]{7}$") & ((d(1) + d(3) + d(5) + 2 * (d(2) + d(4) + d(6))) % 10 == d(7)), F.lit(False))


def registry_audit(providers: DataFrame) -> DataFrame:
    return providers.groupBy("specialty").agg(
        F.count("*").alias("n"), F.count_if(~npi_valid(F.col("npi"))).alias("bad_npi"), F.count_if(~dea_valid(F.col("dea"))).alias("bad_dea")
    )


def catalog_qa(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per check of a pair catalogue: how many rows fail it."""
    missing_back = pairs.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    unknown = pairs.join(catalog.select(F.col("key").alias("b")), "b", "left_anti")
    unflagged = pairs.join(catalog.filter(~F.col("is_lasa")).select(F.col("key").alias("b")), "b", "left_semi")
    doubled = catalog.groupBy("key").count().filter("count > 1")
    check = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))
    out = check("reciprocal", missing_back).union(check("target_exists", unknown)).union(check("target_flagged", unflagged)).union(check("unique_key", doubled))
    return out.withColumn("passed", F.col("failures") == 0)


def frozen_digest(*columns: str) -> Column:
    """An aggregate that names a set of rows whatever their order: their number and the sums of two halves of
    their hashes. Tasks add up what they have, so no rows are moved or sorted; a row that repeats counts again."""
    row = F.md5(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.when(F.count("*") > 0, F.concat_ws(":", F.count("*").cast("string"), half(1), half(16)))


def template_qa(templates: DataFrame, minimums: DataFrame) -> DataFrame:
    """One row per check of a template catalogue: check, failures, passed.

    ``templates(template_id, category, text, slots)``: each placeholder ``{name}`` of a text must be one of its declared slots, a
    null text or null slots having none. ``minimums(category, least)``: categories with too few templates, or with none, fail.
    """
    none = F.array().cast("array<string>")
    named = F.coalesce(F.regexp_extract_all("text", F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)), none)
    undeclared = templates.filter(F.size(F.array_except(named, F.coalesce("slots", none))) > 0)
    counted = templates.groupBy("category").agg(F.count("*").alias("n"))
    few = minimums.join(counted, "category", "left").filter(F.coalesce("n", F.lit(0)) < F.col("least"))
    check = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))
    return check("slots_declared", undeclared).union(check("category_minimum", few)).withColumn("passed", F.col("failures") == 0)


#: Checkpoints that are not for release, as parts of their names.
FORBIDDEN = ("debug", "scratch")


def release_gate(reports: DataFrame, allowed: float = 1.05, strict: bool = False, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """Each candidate's first reason against promotion, if any: run, split, manifest_hash, cer, base_cer, reason, promote.

    ``reports`` has role, run, split, measured, manifest_hash, sample_count, cer, failures, checkpoint, checkpoint_hash, domain,
    covered, required, audited and lasa_violations; a baseline is needed for each split, on the very same rows. A rate may
    be ``allowed`` times the baseline's, or must be below it if ``strict``. A clinical candidate needs all directions
    of its name pairs covered by an audit that was not empty. Null counts as missing.
    """
    columns = ["split", "measured", "manifest_hash", "sample_count", "cer", "failures"]
    base = reports.filter("role = 'baseline'").select("split", *[F.col(c).alias(f"base_{c}") for c in columns[1:]])
    joined = reports.filter("role = 'candidate'").join(base, "split", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(~c, F.lit(True))
    invalid = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    banned = F.coalesce(F.replace("checkpoint", F.lit("\\"), F.lit("/")).rlike("|".join(f"\\Q{x}\\E" for x in forbidden)), F.lit(False))
    limit = F.col("cer") >= F.col("base_cer") if strict else F.col("cer") > F.col("base_cer") * allowed + 1e-9
    reason = (
        F.when(no(F.col("measured")) | (zero("sample_count") <= 0) | blank("manifest_hash"), "unmeasured")
        .when(no(F.col("base_measured")) | no(F.col("base_manifest_hash") == F.col("manifest_hash")) | no(F.col("base_sample_count") == F.col("sample_count")), "baseline_not_on_same_split")
        .when(invalid("cer") | invalid("base_cer"), "invalid_rate")
        .when((zero("failures") > 0) | (zero("base_failures") > 0), "failures")
        .when(blank("checkpoint_hash"), "missing_checkpoint_hash")
        .when((F.coalesce("domain", F.lit("")) == "clinical") & ((zero("required") <= 0) | (zero("covered") != zero("required")) | (zero("audited") <= 0)), "incomplete_coverage")
        .when(banned, "forbidden_checkpoint")
        .when(limit, "not_below_baseline" if strict else "rate_regression")
        .when(zero("lasa_violations") > 0, "lasa_violations")
    )
    return joined.select("run", "split", "manifest_hash", "cer", "base_cer", reason.alias("reason"), reason.isNull().alias("promote"))


def reciprocal_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("drug_a").alias("a"), F.col("drug_b").alias("b")).union(pairs.select("drug_b", "drug_a"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
