"""Linking tokens to a vocabulary: exactly, by prefix, by edit distance, and with context."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.align import osa_within
from scriptorium.sources.files import stored

#: Longest phrase, in words.
PHRASE = 4
#: Keys are blocked on deletions from their first characters: few enough that long words emit few blocks, enough that blocks hold few pairs.
BLOCK_PREFIX = 9


def merge_entries(entries: DataFrame) -> DataFrame:
    """Entries of one key become one: the first word, the largest weight."""
    return entries.groupBy("key").agg(F.min_by("word", "load_order").alias("word"), F.max("weight").alias("weight"))


def exact(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with their entry; the lexicon is broadcast when its size allows."""
    return tokens.join(lexicon, "key")


def phrases(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The longest entry of up to ``PHRASE`` words that starts at each token."""
    at = Window.partitionBy("doc_id", "line_no").orderBy("pos")
    nexts = [F.col("key"), *[F.lead("key", k).over(at) for k in range(1, PHRASE)]]
    grown = tokens.select("doc_id", "line_no", "pos", F.array(*nexts).alias("w"))
    tried = grown.select("doc_id", "line_no", "pos", "w", F.explode(F.sequence(F.lit(1), F.lit(PHRASE))).alias("n"))
    tried = tried.select("doc_id", "line_no", "pos", "n", F.when(F.get("w", F.col("n") - 1).isNotNull(), F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("key"))
    found = tried.join(lexicon, "key")
    return found.groupBy("doc_id", "line_no", "pos").agg(F.max_by(F.struct("word", "weight", "n"), "n").alias("m")).select("doc_id", "line_no", "pos", "m.word", "m.weight", F.col("m.n").cast("long").alias("n_words"))


def contexts(lines: DataFrame, longest: int = PHRASE) -> DataFrame:
    """The distinct runs of up to ``longest`` keys that start at the tokens of ``lines(keys)``, shorter ones only at the
    end of a line, with their number: context, n. Lines meet nothing else, so that a run is exchanged once for all its places."""
    runs = F.transform("keys", lambda _, i: F.array_join(F.slice("keys", i + 1, longest), " "))
    return lines.select(F.explode(runs).alias("context")).groupBy("context").agg(F.count("*").alias("n"))


def phrase_counts(runs: DataFrame, lexicon: DataFrame, longest: int = PHRASE) -> DataFrame:
    """What ``phrases`` finds, counted: key, word, weight, n_words, n. ``runs`` are ``contexts`` of ``longest`` keys, as many as
    any entry of ``lexicon(key, word, weight)`` has. Runs without an entry are shortened by a key and counted anew."""
    entries = lexicon.select(F.col("key").alias("entry"), F.col("word").alias("its_word"), F.col("weight").alias("its_weight"))
    types = {x.name: x.dataType for x in lexicon.schema}
    none = lambda kind: F.lit(None).cast(kind)
    runs = runs.select("context", none(types["word"]).alias("word"), none(types["weight"]).alias("weight"), none("long").alias("n_words"), "n")
    for size in range(longest, 0, -1):
        # rows that have their entry go along, so that runs are exchanged once; those that a line's end cut short wait for their size
        open_ = F.col("n_words").isNull() & (F.size(F.split("context", " ")) == size)
        met = runs.join(entries, (F.col("context") == F.col("entry")) & open_, "left")
        new, old = F.col("entry").isNotNull(), F.col("n_words").isNotNull()
        key = F.when(new | old, F.col("context")).otherwise(F.substring_index("context", " ", size - 1))
        now = lambda c, its: F.when(new, its).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        rows = met.select(key.alias("context"), now("word", F.col("its_word")), now("weight", F.col("its_weight")), now("n_words", F.lit(size).cast("long")), "n")
        runs = rows.groupBy("context", "word", "weight", "n_words").agg(F.sum("n").alias("n")) if size > 1 else rows
    return runs.filter("n_words is not null").withColumnRenamed("context", "key")


def prefix_matches(queries: DataFrame, lexicon: DataFrame, most: int = 50) -> DataFrame:
    """For each ``query`` up to ``most`` words by weight, ties in key order. The lexicon's exploded prefixes are
    ranked and cut first, so that queries meet ``most`` rows each at most in one equi-join."""
    grown = lexicon.select("key", "word", "weight", F.explode(F.expr("transform(sequence(1, length(key)), i -> left(key, i))")).alias("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "key"))
    return queries.join(grown.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most), "query")


def allowed_distance(length, most: int):
    """Short keys allow less: none up to one character, one for two."""
    return F.when(length <= 1, 0).when(length == 2, F.least(F.lit(1), F.lit(most))).otherwise(most)


def _deletions(keys: DataFrame, most: int) -> DataFrame:
    """``block`` values: all strings left when up to ``most`` of the first characters are deleted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key in frame["key"]:
                head = key[:BLOCK_PREFIX]
                found = {head}
                for n in range(1, min(most, len(head)) + 1):
                    found.update("".join(c for k, c in enumerate(head) if k not in gone) for gone in combinations(range(len(head)), n))
                rows.extend((key, b) for b in found)
            yield pd.DataFrame(rows, columns=["key", "block"])

    return keys.mapInPandas(run, "key string, block string")


def fuzzy(tokens: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """Distinct token keys with the entries within OSA distance: token, key, word, weight, distance, sim, rank.

    Pairs meet when their first characters agree after deletions, which two keys within the
    distance always do; a banded Levenshtein of twice the distance prunes natively, what is left is verified many pairs at
    a time, and only pairs that hold are exchanged.
    """

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = frame.assign(distance=osa_within(frame["token"].tolist(), frame["key"].tolist(), most).astype("int32"))
            yield found[found["distance"] <= most]

    # few bytes make much work here, so the number of tasks is given and does not follow from the bytes
    spark = tokens.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left = _deletions(tokens.select("key").distinct().repartition(parts), most).withColumnRenamed("key", "token").repartition(parts, "block")
    right = _deletions(lexicon.select("key").distinct().repartition(parts), most).repartition(parts, "block")
    a, b = F.length("token"), F.length("key")
    pairs = left.join(right, "block").select("token", "key").filter((F.abs(a - b) <= most) & (F.levenshtein("token", "key", 2 * most) >= 0))
    found = pairs.mapInPandas(verify, "token string, key string, distance int").filter(F.col("distance") <= allowed_distance(a, most)).distinct()
    scored = found.join(lexicon, "key").withColumn("sim", 1 - F.col("distance") / F.greatest(a, b))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("distance", F.desc(F.col("sim") + 0.1 * F.col("weight")), "key"))
    return scored.withColumn("rank", rank)


def nearest(tokens: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """The first entry of each token of ``fuzzy``. Entries further away are looked for only for tokens that have none so near."""
    left, found = stored(tokens.select("key").distinct(), "tokens"), None
    for distance in range(1, most + 1):
        first = fuzzy(left, lexicon, distance).filter("rank = 1")
        if distance < most:
            first = stored(first, "nearest")
            left = left.join(first.select(F.col("token").alias("key")), "key", "left_anti")
        found = first if found is None else found.union(first)
    return found


def search(queries: DataFrame, lexicon: DataFrame, most: int = 6) -> DataFrame:
    """Each query's best entries by tier: exact, prefix, substring, near. Substrings and near entries
    need three characters; near is OSA 1 up to five characters and 2 beyond.

    All tiers are equi-joins that miss nothing: on exploded prefixes, on the query's first trigram, which
    every entry that holds the query has, and on the deletion blocks of ``fuzzy``.
    """
    queries, entries = queries.select("query").distinct(), lexicon.select("key", "word", "weight").distinct()
    q, k, w, distance = F.col("query"), F.col("key"), F.col("weight"), F.col("distance")
    long, keys = queries.filter(F.length(q) >= 3), entries.select("key").distinct()
    prefixes = keys.select("key", F.explode(F.expr("transform(sequence(1, greatest(1, length(key))), i -> left(key, i))")).alias("query"))
    grams = keys.filter("length(key) >= 3").select("key", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(key) - 2), i -> substring(key, i, 3))"))).alias("gram"))
    inside = long.withColumn("gram", F.left("query", F.lit(3))).join(grams, "gram").filter(F.contains(k, q))
    met = queries.join(prefixes, "query").select("query", "key", F.lit(None).cast("int").alias("distance")).union(inside.select("query", "key", F.lit(None).cast("int")))
    for part, most_edits in ((long.filter(F.length(q) <= 5), 1), (long.filter(F.length(q) > 5), 2)):
        met = met.union(fuzzy(part.select(q.alias("key")), entries, most_edits).select("token", "key", "distance"))
    met = met.groupBy("query", "key").agg(F.min("distance").alias("distance")).join(entries, "key")
    score = (
        F.when(q == k, 1000 + w)
        .when(F.startswith(k, q), 500 + 100 * F.length(q) / F.length(k) + 0.5 * w)
        .when((F.length(q) >= 3) & F.contains(k, q), 300 + 0.4 * w)
        .otherwise(200 * (1 - distance / F.greatest(F.length(q), F.length(k))) + 0.3 * w)
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return met.select("query", "key", "word", "weight", F.round(score, 6).alias("score")).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """Distinct terms, prefix-tree nodes (distinct prefixes and the root), depth, and bytes at 56 a node."""
    prefixes = lexicon.select("key", F.explode(F.expr("transform(sequence(1, length(key)), i -> left(key, i))")).alias("p"))
    return prefixes.agg(F.count_distinct("key").alias("terms"), (F.count_distinct("p") + 1).alias("nodes"), F.max(F.length("key")).cast("long").alias("depth")).withColumn("bytes", F.col("nodes") * 56)


#: Routes, forms and frequencies that a line may name.
ROUTES = "po|iv|im|sc|sl|pr|oral|topical"
FORMS = "tablet|tab|capsule|cap|syrup|cream|injection"
FREQUENCIES = "qd|bid|tid|qid|prn|qhs|daily"


def context_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """First dosage, route, frequency and form of a line; given columns of those names win."""
    pick = lambda pattern: F.nullif(F.regexp_extract(text, rf"(?i)\b({pattern})\b", 1), F.lit(""))
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    dose = F.lower(F.regexp_replace(pick(r"\d+(?:\.\d+)? ?(?:mg|mcg|g|ml)"), " ", ""))
    return rows.withColumns(
        {
            "dosage": F.coalesce(has("dosage"), dose), "route": F.coalesce(has("route"), F.upper(pick(ROUTES))),
            "frequency": F.coalesce(has("frequency"), F.upper(pick(FREQUENCIES))), "form": F.coalesce(has("form"), F.lower(pick(FORMS))),
        }
    )


def dose_mg(value: str):
    """A dose in mg from ``500mg``, ``1g``, ``250mcg``."""
    number = F.regexp_extract(value, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(value, r"([a-zA-Z]+)$", 1))
    return number * F.when(unit == "g", 1000.0).when(unit.isin("mcg", "ug"), 0.001).otherwise(1.0)


def dose_compatibility(lines: DataFrame, medications: DataFrame) -> DataFrame:
    """Score of a line's dose, route and frequency against the medication that it names.

    ``medications(term, strengths array<double>, route, max_dose)`` is a dimension.
    """
    dose = F.col("dose")
    standard = F.exists("strengths", lambda s: F.abs(s - dose) < 1e-9)
    score = (
        F.when(dose.isNull(), 0.0).when(standard, 1.0).otherwise(-0.4)
        + F.when(F.col("route").isNull(), 0.0).when(F.col("route") == F.col("med_route"), 0.5).otherwise(-0.3)
        + F.when(F.col("frequency").isNotNull(), 0.5).otherwise(0.0)
        + F.when((dose > 50000) | (dose > 5 * F.col("max_dose")), -1.0).otherwise(0.0)
    )
    return lines.join(medications, "term").withColumn("score", F.round(score, 4))


def lasa_warnings(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found(key, kind, ...)`` with a ``warning`` for entries that look or sound like others, which it lists in order; null
    for other entries and for codes. The catalogue is folded to one row a name first."""
    both = pairs.select(F.col("drug_a").alias("key"), F.col("drug_b").alias("other")).union(pairs.select("drug_b", "drug_a")).filter("key <> other")
    listed = both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("others"))
    text = F.when(F.col("kind") == 1, F.concat(F.lit("Look-alike: "), "others"))
    return found.join(listed, "key", "left").withColumn("warning", text).drop("others")


def annotate(tokens: DataFrame, codes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct codes, then entries, that a document's tokens name, in order of first occurrence. See ``lasa_warnings``."""
    entries = codes.selectExpr("key", "translation as meaning", "0 as kind").union(lexicon.filter("length(key) >= 3").selectExpr("key", "word as meaning", "1 as kind"))
    # a document's distinct words meet the entries, with the place of the first one as one number
    place = F.shiftleft(F.col("line_no").cast("long"), 32) + F.col("pos")
    first = tokens.groupBy("doc_id", "key").agg(F.min(place).alias("at")).join(entries, "key")
    first = first.groupBy("doc_id", "kind", "key").agg(F.min("at").alias("at"), F.first("meaning").alias("meaning"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "at", "key"))
    return first.select("doc_id", rank.cast("long").alias("rank"), "kind", "key", "meaning")


def merge_costs(defaults: DataFrame, profiles: DataFrame) -> DataFrame:
    """Default pair costs with profile costs upserted, both ways round: ``profiles(src, tgt, sim)``
    cost 1 - sim + 0.15 within [0.15, 0.60]."""
    price = F.least(F.greatest(F.round(1 - F.col("sim") + 0.15, 2), F.lit(0.15)), F.lit(0.60))
    new = profiles.select("src", "tgt", price.alias("new"))
    new = new.union(new.select("tgt", "src", "new")).groupBy("src", "tgt").agg(F.min("new").alias("new"))
    old = defaults.select("src", "tgt", "cost").union(defaults.select("tgt", "src", "cost")).groupBy("src", "tgt").agg(F.min("cost").alias("cost"))
    return old.join(new, ["src", "tgt"], "full").select("src", "tgt", F.coalesce("new", "cost").alias("cost"))


def pair_costs(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """``pairs(src, tgt, ...)`` with the cost of each by ``costs(src, tgt, cost)``: 0 if both are equal, the table's, else 1.20
    for single characters and infinity for longer shapes, which nothing else makes possible. Null for a null shape."""
    found = pairs.join(costs.select("src", "tgt", "cost").dropDuplicates(["src", "tgt"]), ["src", "tgt"], "left")
    single = (F.length("src") == 1) & (F.length("tgt") == 1)
    cost = F.when(F.col("src") == F.col("tgt"), 0.0).when(F.col("cost").isNotNull(), F.col("cost")).when(single, 1.20)
    return found.withColumn("cost", F.when(F.col("src").isNotNull() & F.col("tgt").isNotNull(), F.coalesce(cost, F.lit(float("inf")))))
