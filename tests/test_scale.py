"""Steps that must grow with their input and no faster, and what they must not change."""

import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from scriptorium.functions.align import edit_counts
from scriptorium.functions.multigram import MultigramAligner
from scriptorium.operators import confusion, documents
from scriptorium.plans import review, views


def test_one_row_group_is_dealt_out_at_any_size(spark, tmp_path, monkeypatch):
    n = 400
    rows = pa.table({"doc_id": list(range(n)), "text": ["a line"] * n, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [6] * n})
    pq.write_table(rows, tmp_path / "documents.parquet")
    monkeypatch.setattr(views, "SPREAD_BYTES", 0, raising=False)  # a file beyond the size up to which rows were dealt out
    lines = views.Views(spark, str(tmp_path)).lines
    per_task = lines.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(per_task) == n and max(per_task) < n / 2


def test_long_looping_lines_take_linear_time(spark):
    words = [f"w{k}" for k in range(40_000)]
    rows = spark.createDataFrame([(1, 1, " ".join([*words, *["so it"] * 8, "end"])), (1, 2, "Ab aB x " * 6 + "z"), (1, 3, None)], "doc_id long, line_no long, text string")
    began = time.time()
    got = {r.line_no: (r.text, r.loops) for r in documents.collapse_loops(rows).collect()}
    assert time.time() - began < 30
    assert got[1] == (" ".join([*words, *["so it"] * 2]), 1) and got[2] == ("Ab aB x Ab aB", 1) and got[3] == (None, 0)


def test_edit_counts_of_long_lines():
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    began = time.time()
    assert edit_counts(line, line[:-2] + "x") == (1, 1, 0, 19_998)
    assert time.time() - began < 3


def test_beam_picks_exchange_no_words_but_to_meet_the_vocabulary(spark):
    rows = [(1, 1, b, t, 0.0) for b, t in enumerate(["the the cat", "the cat sat", "12345 cat", "The cat"])]
    beams = spark.createDataFrame(rows, "doc_id long, line_no long, beam_no int, text string, log_prob double").repartition(4, "doc_id")
    picked = confusion.language_pick(beams, spark.createDataFrame([("the",), ("cat",)], "key string"))
    assert [tuple(r) for r in picked.collect()] == [(1, 1, 3, 2.4, None)]
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2


def test_alignments_of_lines_that_differ_in_one_letter_stay_in_the_first_band(monkeypatch):
    filled, whole = [], MultigramAligner._filled

    def counted(self, a, b, n, m, band, trace):
        filled.extend(band.tolist())
        return whole(self, a, b, n, m, band, trace)

    monkeypatch.setattr(MultigramAligner, "_filled", counted)
    lines = ["the rest were eaten before evening " * 12, "in torn papers " * 20]
    found = MultigramAligner(confusion.both_ways(confusion.COSTS)).steps([lines[0].replace("e", "c"), lines[1].replace("rn", "m")], lines)[1]
    assert filled == [4, 4]
    steps = found.texts([lines[0].replace("e", "c"), lines[1].replace("rn", "m")], lines)
    assert Counter(s[:4] for s in steps) == {(0, "substitute", "c", "e"): lines[0].count("e"), (1, "substitute", "m", "rn"): 20}


def test_beam_picks_sort_no_words_to_see_their_neighbours(spark):
    rows = [(1, 1, b, t, 0.0) for b, t in enumerate([" a . the the Cat", "the  cat, sat", "cat 12345 So", "the Cat"])] + [(2, 1, 0, None, 0.0)]
    beams = spark.createDataFrame(rows, "doc_id long, line_no long, beam_no int, text string, log_prob double").repartition(4, "doc_id")
    picked = confusion.language_pick(beams, spark.createDataFrame([("the",), ("cat",)], "key string"))
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1
    # the fourth beam: two known words, a name
    assert [tuple(r) for r in picked.filter("doc_id = 1").collect()] == [(1, 1, 3, 2.4, None)]


def test_exported_cells_take_less_room_than_they_have_letters(spark, tmp_path, monkeypatch):
    folder = tmp_path / "scratch"
    monkeypatch.setattr(review, "scratch", lambda _: f"file://{folder}")
    text = "\n".join(" ".join(f"word{k}" for k in range(j, j + 30)) for j in range(200))
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = review.snk2(spark, str(tmp_path))
    assert rows.count() == 6000 and rows.filter("text = 'word5' and original_text = 'word5'").count() > 0
    assert sum(f.stat().st_size for f in folder.rglob("part-*")) < 4 * len(text)
