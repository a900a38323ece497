"""Steps that many queries share: what they must not do again for each token, and what their results must stay."""

import random
import time

from scriptorium.functions.align import edit_distance, edit_distances
from scriptorium.operators import documents, lexicon, pages
from scriptorium.plans.views import Views


def _documents(spark, folder, texts):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("Fine Pen", "STEEL"), ("fine pen", "steel")], "p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
    return Views(spark, str(folder))


def test_tokens_are_counted_once_and_the_lexicon_has_a_size(spark, tmp_path):
    v = _documents(spark, tmp_path, ["Straße  a\tb,\x7f c\n\n - It's it's " * 20, "ÉTÉ été\r\n! ?? x_1-2 " * 20, "", "ΟΔΟΣ ΟΔΟΣ, "])
    split = {}
    for r in v.tokens.collect():
        split[r.key] = split.get(r.key, 0) + 1
    assert {r.key: r.n for r in v.counts.collect()} == split and {"straße", "ab", "c", "-", "its", "été", "x_1-2", "οδος"} <= split.keys()
    for small in (v.lexicon, v.pairs):
        assert "Aggregate" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: r.weight for r in v.lexicon.collect()}["its"] == 1.5


def test_keys_are_made_once_a_line(spark, tmp_path):
    v = _documents(spark, tmp_path, ["Words of one line, Words!"])
    plan = v.tokens.filter("length(key) >= 2 and key rlike '^w'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_\\s-]") == 1
    assert [(r.pos, r.key) for r in v.tokens.orderBy("pos").collect()] == [(0, "words"), (1, "of"), (2, "one"), (3, "line"), (4, "words")]


def test_many_distances_at_a_time_are_those_of_single_pairs():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdé 😀") for _ in range(n))
    a, b = [], []
    for _ in range(2500):
        a.append(word(r.choice([0, 1, 5, 30, 64, 65, 130, 200])))
        b.append("".join(c for c in a[-1] if r.random() > 0.05).replace("ab", r.choice(["ab", "c"])) if r.random() < 0.8 else word(r.randrange(200)))
    assert edit_distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b, strict=True)]
    a, b = [t.split(" ") for t in a], [t.split(" ") for t in b]
    assert edit_distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert edit_distances([], []).tolist() == []


def test_distances_of_many_lines_take_a_fraction_of_single_ones():
    r = random.Random(4)
    lines = [" ".join("".join(r.choice("abcdefghinrm") for _ in range(r.randrange(2, 12))) for _ in range(50)) for _ in range(600)]
    for change in (str.upper, lambda t: t.replace("rn", "m").replace("in", "m"), lambda t: t.replace("e", "c")):
        other = [change(t) for t in lines]
        began = time.process_time()
        edit_distances(lines, other)
        many = time.process_time() - began
        began = time.process_time()
        for x, y in zip(lines[:60], other[:60], strict=True):
            edit_distance(x, y)
        assert many < 10 * (time.process_time() - began) / 2


def test_a_line_of_one_long_word_takes_linear_time(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 100_000 + " 7"), (1, 1, "of." + "b" * 100_000 + " 8"), (1, 2, 'He said "no')], "page long, line long, text string")
    began = time.time()
    fixed = [r.fixed for r in pages.continue_lines(rows).orderBy("line").collect()]
    assert time.time() - began < 15
    assert fixed == ["a" * 100_000 + " 7", "of." + "b" * 100_000 + " 8", 'He said "no."']


def test_pages_are_cleaned_many_at_a_time_and_once_exchanged(spark):
    rows = spark.createDataFrame([(1, 2, "the same"), (1, 0, "The Same "), (1, 1, "Other words here, in full"), (2, 0, "the same")], "page long, line long, text string")
    out = pages.finalize(rows)
    assert sorted((r.page, r.line) for r in out.collect()) == [(1, 0), (1, 1), (2, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan


def test_fuzzy_pairs_are_verified_before_they_are_exchanged(spark):
    words = spark.createDataFrame([("morning",), ("mornign",), ("evening",), ("xy",)], "key string")
    entries = spark.createDataFrame([("morning", "morning", 1.0), ("evenings", "evenings", 1.0), ("yx", "yx", 1.0)], "key string, word string, weight double")
    found = lexicon.fuzzy(words, entries)
    got = {(r.token, r.key): r.distance for r in found.collect()}
    assert got == {("morning", "morning"): 0, ("mornign", "morning"): 1, ("evening", "evenings"): 1, ("xy", "yx"): 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    verified = plan.index("MapInPandas")
    assert "Aggregate" not in plan[verified : plan.index("Join Inner", verified)]


def test_corrections_meet_lines_and_not_words(spark):
    words = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 1, 0, "c"), (2, 0, 0, None)], "doc_id long, line_no long, word_no long, text string")
    made = [(1, 0, 1, "X", 1, 1), (1, 0, 1, "B", 2, 2), (1, 0, None, "Z", 1, 3), (1, 1, 0, "c", 1, 4), (1, 0, 0, None, 1, 5)]
    out = documents.apply_corrections(words, spark.createDataFrame(made, "doc_id long, line_no long, word_no long, correction string, ts int, event_id int"))
    got = {(r.doc_id, r.line_no): (r.text, r.edited_words, r.reviewed) for r in out.collect()}
    assert got == {(1, 0): ("a B", 1, True), (1, 1): ("c", 0, True), (2, 0): ("", 0, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "word_no" not in join and "line_no" in join
