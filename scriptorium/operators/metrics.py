"""Recognition metrics over (reference, hypothesis) rows, telemetry profiles, and comparisons."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from scriptorium.functions.align import edit_counts, edit_distances


#: Pairs whose table has more cells than this go to Arrow batches, which measure many at a time.
NATIVE_CELLS = 48 * 48
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _of_known(a: pd.Series, b: pd.Series, cut: Callable) -> pd.Series:
    """Distances of the pairs that are not null, measured together."""
    out, known = pd.Series(pd.NA, index=a.index, dtype="Int32"), a.notna().to_numpy()
    out[known] = edit_distances([cut(t) for t in a[known]], [cut(t) for t in b[known]])
    return out


@F.pandas_udf(IntegerType())
def _long_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_known(a, b, lambda t: t)


@F.pandas_udf(IntegerType())
def _word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_known(a, b, lambda t: [w for w in _SPACE.split(t) if w])


def char_edits(ref: Column | str, hyp: Column | str) -> Column:
    """Levenshtein distance. Equal texts, the common case, are settled without a table and short ones
    natively; the others are measured many at a time in Arrow batches."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (ref, hyp))
    long = (a != b) & (F.length(a).cast("long") * F.length(b) > NATIVE_CELLS)
    native = F.when(a == b, 0).when(~long, F.levenshtein(a, b))
    return F.coalesce(native, _long_edits(F.when(long, a), F.when(long, b)))


def word_edits(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over words. Spark has none over arrays, so all unequal pairs go through
    Arrow batches; a code per word in SQL would be found anew for each word."""
    other = ref != hyp
    return F.coalesce(F.when(~other, 0), _word_edits(F.when(other, ref), F.when(other, hyp)))


def _words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def rate(edits: Column, total: Column, hyp_total: Column) -> Column:
    """Micro rate; with an empty reference 0 if the hypotheses are empty too, else 1."""
    return F.when(total > 0, edits / total).when(hyp_total > 0, 1.0).otherwise(0.0)


def error_rates(rows: DataFrame, by: list[str] | None = None, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Character and word error rates per group, with the sums they come from."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    measured = rows.select(
        *(by or []), char_edits(r, h).alias("ce"), F.length(r).alias("rc"), F.length(h).alias("hc"),
        word_edits(r, h).alias("we"), F.size(_words(r)).alias("rw"), F.size(_words(h)).alias("hw"),
    )
    total = measured.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("ce", "rc", "hc", "we", "rw", "hw"))
    )
    c = F.col
    return total.select(
        *(by or []), "n", c("ce").alias("char_edits"), c("rc").alias("ref_chars"), c("we").alias("word_edits"), c("rw").alias("ref_words"),
        F.round(rate(c("ce"), c("rc"), c("hc")), 4).alias("cer"), F.round(rate(c("we"), c("rw"), c("hw")), 4).alias("wer"),
    )


def edit_breakdown(rows: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Substitutions, deletions, insertions and hits of characters and words, summed per group.

    Equal pairs are settled natively; only the others, each distinct pair once, reach Python.
    """
    names = ["s", "d", "i", "h", "ws", "wd", "wi", "wh"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts = [(*edit_counts(a, b), *edit_counts(a.split(), b.split())) for a, b in zip(f["ref"], f["hyp"], strict=True)]
            yield pd.concat([f[[*by, "n"]].reset_index(drop=True), pd.DataFrame(counts, columns=names, dtype="int64")], axis=1)

    pairs = rows.groupBy(*by, F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    same = pairs.filter("ref = hyp").select(*by, "n", *([zero] * 3), F.length("ref").cast("long"), *([zero] * 3), F.size(_words(F.col("ref"))).cast("long"))
    kinds = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in by] + ["n long"] + [f"{c} long" for c in names])
    other = pairs.filter("ref <> hyp").mapInPandas(run, kinds)
    return same.toDF(*by, "n", *names).union(other).groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in names))


def metric_bundle(rows: DataFrame) -> DataFrame:
    """Cased and uncased character rate, word rate, mean rate of a row, exact share and length gap of rows
    whose references are not empty."""
    r, h = F.col("ref"), F.col("hyp")
    measured = rows.select("ref", "hyp", char_edits(r, h).alias("ce"), char_edits(F.lower(r), F.lower(h)).alias("lower_ce"), word_edits(r, h).alias("we"))
    return measured.agg(
        F.count("*").alias("n"),
        F.round(F.sum("ce") / F.sum(F.length(r)), 4).alias("cer"),
        F.round(F.sum("we") / F.sum(F.size(_words(r))), 4).alias("wer"),
        F.round(F.sum("lower_ce") / F.sum(F.length(r)), 4).alias("cer_uncased"),
        F.round(F.avg(F.col("ce") / F.length(r)), 4).alias("mean_row_cer"),
        F.round(F.avg((r == h).cast("int")), 4).alias("exact_rate"),
        F.round(F.avg(F.abs(F.length(r) - F.length(h)) / F.length(r)), 4).alias("length_gap"),
    )


def stratified(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """Character and word error rates and exact rows by ``group``, by ``flag`` and overall: distances are measured
    once a row and summed once for each pair of group and flag, then come the grouping sets."""
    r, h = F.col("ref"), F.col("hyp")
    measured = rows.select(group, flag, char_edits(r, h).alias("ce"), F.length(r).alias("rc"), word_edits(r, h).alias("we"), F.size(_words(r)).alias("rw"))
    sums = {"k": F.count("*"), "e": F.sum("ce"), "c": F.sum("rc"), "we": F.sum("we"), "w": F.sum("rw"), "x": F.count_if(F.col("ce") == 0)}
    each = measured.groupBy(group, flag).agg(*(v.alias(k) for k, v in sums.items()))
    return each.groupingSets([[F.col(group)], [F.col(flag)], []], F.col(group), F.col(flag)).agg(
        F.sum("k").alias("n"), F.sum("e").alias("edits"), F.round(F.sum("e") / F.sum("c"), 4).alias("cer"),
        F.sum("we").alias("word_edits"), F.round(F.sum("we") / F.sum("w"), 4).alias("wer"), F.sum("x").alias("exact"),
    )


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", ""))


def name_hit(ref: Column, hyp: Column) -> Column:
    """Whether the first word, without punctuation and case, is right; null for a reference without words."""
    r, h = _plain(ref), _plain(hyp)
    first = lambda c: F.element_at(F.split(c, " +"), 1)
    return F.when(r != "", ((first(r) == first(h)) | (r == h)).cast("int"))


def name_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows whose first word, without punctuation and case, is right."""
    hit = name_hit(F.col("ref"), F.col("hyp"))
    return rows.withColumn("hit", hit).filter("hit is not null").groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 4).alias("name_accuracy"))


def win_tie_loss(stages: DataFrame, baseline: int = 1) -> DataFrame:
    """Rows of each stage below, within 1e-5 of, and above the baseline stage's error rate."""
    keyed = stages.withColumn("cer", char_edits("ref", "hyp") / F.length("ref"))
    base = F.max(F.when(F.col("stage_no") == baseline, F.col("cer"))).over(Window.partitionBy("doc_id", "line_no"))
    gap = F.col("cer") - F.col("base")
    return keyed.withColumn("base", base).groupBy("stage_no").agg(
        F.count_if(gap < -1e-5).alias("wins"), F.count_if(F.abs(gap) <= 1e-5).alias("ties"), F.count_if(gap > 1e-5).alias("losses")
    )


def tier_compare(stages: DataFrame) -> DataFrame:
    """Each tier's error rates, name accuracy and median latency, and its absolute and relative gain in
    character rate over the first tier. Without a column ``ms`` the median is null."""
    r, h = F.col("ref"), F.col("hyp")
    ms = F.col("ms") if "ms" in stages.columns else F.lit(None).cast("double")
    measured = stages.select("stage_no", ms.alias("ms"), F.length(r).alias("rc"), char_edits(r, h).alias("ce"), word_edits(r, h).alias("we"), F.size(_words(r)).alias("rw"), name_hit(r, h).alias("hit"))
    tiers = measured.groupBy("stage_no").agg(
        (F.sum("ce") / F.sum("rc")).alias("rate"), (F.sum("we") / F.sum("rw")).alias("wer"), F.avg("hit").alias("hit"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.count_if(F.col("ce") == 0).alias("exact")
    )
    first = F.first("rate").over(Window.orderBy("stage_no"))  # a row per tier
    gain = F.col("first") - F.col("rate")
    return tiers.withColumn("first", first).select(
        "stage_no", F.round("rate", 4).alias("cer"), F.round(gain, 4).alias("gain"),
        F.when(F.col("first") > 0, F.round(gain / F.col("first") * 100, 2)).otherwise(0.0).alias("relative_gain"),
        F.round("wer", 4).alias("wer"), F.round("hit", 4).alias("name_accuracy"), F.round("p50", 2).alias("p50_ms"), "exact",
    )


def latency_profile(rows: DataFrame) -> DataFrame:
    """Interpolated percentiles and throughput; a batch's latency counts as that of each of its samples."""
    each = F.col("ms") / F.col("batch_size")
    p = F.percentile(each, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]), F.col("batch_size").cast("int")).alias("p")
    n, seconds = F.sum("batch_size"), F.greatest(F.sum("ms") / 1000, F.lit(1e-6))
    mean = F.sum("ms") / n
    spread = F.sqrt(F.greatest(F.sum(each * each * F.col("batch_size")) / n - mean * mean, F.lit(0.0)))
    out = rows.agg(
        p, n.cast("long").alias("samples"), F.round(mean, 2).alias("mean_ms"), F.round(spread, 2).alias("std_ms"), F.round(F.min(each), 2).alias("min_ms"),
        F.round(F.max(each), 2).alias("max_ms"), F.round(n / seconds, 2).alias("samples_per_s"), F.round(F.sum("chars") / seconds, 2).alias("chars_per_s"),
        F.round(F.sum("words") / seconds, 2).alias("words_per_s"),
    )
    for k, name in enumerate(("p50_ms", "p90_ms", "p95_ms", "p99_ms")):
        out = out.withColumn(name, F.round(F.col("p")[k], 2))
    return out.drop("p")


PHASES = ["t_data", "t_transfer", "t_fwd", "t_bwd", "t_opt"]


def step_profile(steps: DataFrame, warmup: int = 10) -> DataFrame:
    """Per run: throughput and phase shares without the first ``warmup`` steps (kept if there are no
    more); peak and last memory over all steps."""
    whole = Window.partitionBy("run")
    step_ms = sum(F.greatest(F.col(c), F.lit(0.0)) for c in PHASES)
    used = steps.withColumns({"steps": F.count("*").over(whole), "t_step": step_ms})
    counted = (F.col("step") > warmup) | (F.col("steps") <= warmup)
    of = lambda c: F.sum(F.when(counted, c))
    shares = [F.round(of(F.greatest(F.col(c), F.lit(0.0))) / of(F.col("t_step")) * 100, 2).alias(f"{c}_pct") for c in PHASES]
    return used.groupBy("run").agg(
        F.count_if(counted).alias("steps"), F.round(of(F.col("num_samples")) / (of(F.col("t_step")) / 1000), 2).alias("samples_per_s"),
        F.round(F.percentile(F.when(counted, F.col("t_step")), 0.5), 2).alias("p50_ms"), F.round(F.avg(F.when(counted, F.col("t_step"))), 2).alias("mean_ms"),
        *shares, F.max("mem").alias("peak_mem"), F.max_by("mem", "step").alias("last_mem"),
    )


def compare_modes(steps: DataFrame) -> DataFrame:
    """Baseline against accelerated steps: speed-up, latency cut, and share of waiting removed."""
    step_ms = sum(F.col(c) for c in PHASES)
    of = lambda mode, c: F.avg(F.when(F.col("mode") == mode, c))
    base, fast = of("baseline", step_ms), of("accelerated", step_ms)
    wait0, wait1 = of("baseline", F.col("t_data")), of("accelerated", F.col("t_data"))
    pct = lambda a, b: F.when(a > 0, F.round((a - b) / a * 100, 2)).otherwise(0.0)
    return steps.agg(
        F.when(fast > 0, F.round(base / fast, 4)).otherwise(0.0).alias("speedup"), pct(base, fast).alias("latency_cut_pct"), pct(wait0, wait1).alias("wait_cut_pct")
    )


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per confidence bin: rows, mean confidence, observed error share and the gap."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long")
    return (
        rows.filter("confidence is not null").groupBy(at.alias("bin"))
        .agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("is_error").cast("int")), 6).alias("error"))
        .withColumn("gap", F.round(F.col("mean_confidence") + F.col("error") - 1, 4))
    )


def worst_rows(rows: DataFrame, n: int) -> DataFrame:
    """The report of the ``n`` rows of highest error rate; ties by id."""
    cer = F.round(char_edits("ref", "hyp") / F.length("ref"), 6)
    return rows.select("doc_id", "line_no", "ref", "hyp", cer.alias("cer")).orderBy(F.desc("cer"), "doc_id", "line_no").limit(n)


def token_overlap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of a's distinct words that b has too."""
    x, y = F.array_distinct(_words(F.lower(a))), F.array_distinct(_words(F.lower(b)))
    return rows.withColumn("overlap", F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0))


def best_epochs(epochs: DataFrame, metric: str = "val_cer", keep_last: int = 5) -> DataFrame:
    """Each epoch with the running best metric (ties by lower training loss), the run's best row, and
    whether its checkpoint is among the last kept."""
    run = Window.partitionBy("run").orderBy("epoch")
    best = F.min(F.struct(F.col(metric), F.col("train_loss"), F.col("epoch"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("epoch")))
    final = F.min(F.struct(F.col(metric), F.col("train_loss"), F.col("epoch"))).over(Window.partitionBy("run"))
    return epochs.withColumns({"best": best, "last": last, "final": final}).select(
        "run", "epoch", F.col(f"best.{metric}").alias("best_metric"), F.col("best.epoch").cast("long").alias("best_epoch"),
        (F.col("final.epoch") == F.col("epoch")).alias("is_final_best"), (F.col("last") <= keep_last).alias("kept"),
    )


def train_progress(steps: DataFrame, planned: int) -> DataFrame:
    """Per run: latest step, speed in steps and samples a second, and minutes left to ``planned``."""
    seconds = F.sum(sum(F.col(c) for c in PHASES)) / 1000
    rate = F.count("*") / seconds
    return steps.groupBy("run").agg(
        F.max("step").cast("long").alias("step"), F.round(rate, 4).alias("steps_per_s"), F.round(F.sum("num_samples") / seconds, 4).alias("samples_per_s"),
        F.round((planned - F.max("step")) / rate / 60, 4).alias("eta_minutes"), F.max_by("mem", "step").alias("last_mem"),
    )
