"""The reference-side operators against plain implementations on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.align import align, edit_counts, edit_distance, osa_distance
from scriptorium.operators import confusion, curation, documents, feedback, lexicon, metrics, pages, safety


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def random_pairs(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(9)))
    return [(word(), word()) for _ in range(n)]


def test_edit_counts_add_up():
    for a, b in random_pairs(300):
        s, d, i, h = edit_counts(a, b)
        assert s + d + h == len(a) and s + i + h == len(b) and s + d + i == lev(a, b)


def test_edit_distance():
    for a, b in random_pairs(400, 7):
        assert edit_distance(a, b) == lev(a, b) == edit_distance(list(a), list(b))


def test_long_pairs_match_plain_ones(spark):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abé") for _ in range(r.randrange(1, 4))) for _ in range(n))
    pairs = [(a := text(150), a[:200] + "x y" + a[230:]), (text(120), text(100)), (text(90), ""), ("", text(90))]
    got = metrics.error_rates(spark.createDataFrame(pairs, "ref string, hyp string")).first()
    assert got.char_edits == sum(lev(a, b) for a, b in pairs) and got.word_edits == sum(lev(a.split(), b.split()) for a, b in pairs)


def test_replay_cycles_differ(spark):
    pool = lambda p, n: spark.createDataFrame([(f"{p}{k}",) for k in range(n)], "key string")
    rows = curation.replay_batches(pool("f", 6), pool("a", 60), 8, 0.25).collect()
    cycles = {}
    for x in sorted((x for x in rows if x.pool == "feedback"), key=lambda x: x.batch):
        cycles.setdefault(x.cycle, []).append(x.key)
    whole = [tuple(c) for c in cycles.values() if len(c) == 6]
    assert len(whole) == 3 and all(set(c) == set(whole[0]) for c in whole)
    batches = lambda **more: len({x.batch for x in curation.replay_batches(pool("f", 6), pool("a", 61), 8, 0.25, **more).collect()})
    assert (batches(), batches(drop_last=True), batches(max_batches=4)) == (11, 10, 4)


def test_feedback_without_a_submission_id_passes(spark):
    row = (None, "d", "a", "b", 0.5, False)
    rows = spark.createDataFrame([row, ("bad id!", *row[1:])], "submission_id string, document_id string, original string, correction string, confidence double, is_demo boolean")
    good, bad = feedback.validate(rows)
    assert good.count() == 1 and bad.first().reasons == ["bad_submission_id"]


def test_osa_distance():
    assert osa_distance("ca", "abc") == 3 and osa_distance("ab", "ba") == 1 and osa_distance("", "ab") == 2
    for a, b in random_pairs(200, 2):
        assert lev(a, b) / 2 <= osa_distance(a, b) <= lev(a, b)


def test_alignment_steps():
    costs = confusion.both_ways(confusion.COSTS)
    cost, steps = align("corn", "com", costs)
    assert ("substitute", "rn", "m", 0.25) in [(o, s, t, round(c, 2)) for o, s, t, c in steps] and round(cost, 2) == 0.25
    for a, b in random_pairs(100, 3):
        cost, steps = align(a, b, costs)
        assert "".join(s for _, s, _, _ in steps) == a and "".join(t for _, _, t, _ in steps) == b
        assert abs(sum(c for *_, c in steps) - cost) < 1e-9


def test_error_rates_match_plain_ones(spark):
    pairs = random_pairs(120, 4) + [("", ""), ("", "x"), ("a b", "")]
    got = metrics.error_rates(spark.createDataFrame(pairs, "ref string, hyp string")).first()
    assert got.char_edits == sum(lev(a, b) for a, b in pairs)
    assert got.word_edits == sum(lev(a.split(), b.split()) for a, b in pairs)
    assert got.ref_words == sum(len(a.split()) for a, _ in pairs)


def test_error_rate_of_nothing(spark):
    empty = metrics.error_rates(spark.createDataFrame([("", "x")], "ref string, hyp string")).first()
    assert empty.cer == 1.0
    assert metrics.error_rates(spark.createDataFrame([], "ref string, hyp string")).first().cer == 0.0


def test_edit_breakdown(spark):
    pairs = random_pairs(60, 5)
    rows = spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, ref string, hyp string")
    got = metrics.edit_breakdown(rows, ["g"]).first()
    assert got.s + got.d + got.h == sum(len(a) for a, _ in pairs)
    assert got.s + got.d + got.i == sum(lev(a, b) for a, b in pairs)
    assert got.ws + got.wd + got.wi == sum(lev(a.split(), b.split()) for a, b in pairs)


def test_normalize(spark):
    rows = spark.createDataFrame([("  Café  THE end! ",), (None,)], "t string")
    got = [r[0] for r in rows.select(T.normalize(F.col("t"), accents=True, punctuation=True, replacements={"the": "a"})).collect()]
    assert got == ["cafe a end", None]
    assert [r[0] for r in spark.createDataFrame([("-",), ("a|b",), (None,)], "t string").select(T.clean_label(F.col("t"))).collect()] == ["", "a b", ""]


def test_search_misses_nothing(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abct") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"trish", "cuts", "form", "from", "cats", "trash", "ab", "abandoned"}
    entries = {w: 0.5 + n % 4 for n, w in enumerate(sorted(words))}
    queries = sorted(words)[::3] + ["trash", "cats", "form", "from", "tarsh", "a", "ab", "x", "abadnoend", "bandon"]

    def score(q, k, w):
        if q == k:
            return 1000 + w
        if k.startswith(q):
            return 500 + 100 * len(q) / len(k) + 0.5 * w
        if len(q) >= 3 and q in k:
            return 300 + 0.4 * w
        d = osa_distance(q, k)
        return 200 * (1 - d / max(len(q), len(k))) + 0.3 * w if len(q) >= 3 and d <= (1 if len(q) <= 5 else 2) else None

    want = set()
    for q in set(queries):
        all_of = sorted((-s, k) for k, w in entries.items() if (s := score(q, k, w)) is not None)
        want |= {(q, k, round(-s, 4)) for s, k in all_of}
    lex = spark.createDataFrame([(k, k, w) for k, w in entries.items()], "key string, word string, weight double")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    assert {(x.query, x.word, round(x.score, 4)) for x in lexicon.search(asked, lex, 10_000).collect()} == want
    assert {x.rank for x in lexicon.search(asked, lex).collect()} == set(range(1, 7))


def test_fuzzy_join_misses_nothing(spark):
    r = random.Random(6)
    make = lambda n: sorted({"".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(n)})
    tokens, keys = make(60), make(60)
    lex = spark.createDataFrame([(k, k, 1.0) for k in keys], "key string, word string, weight double")
    got = {(x.token, x.key): x.distance for x in lexicon.fuzzy(spark.createDataFrame([(t,) for t in tokens], "key string"), lex).collect()}
    allowed = lambda t: 0 if len(t) <= 1 else 1 if len(t) == 2 else 2
    want = {(t, k): d for t, k in itertools.product(tokens, keys) if (d := osa_distance(t, k)) <= allowed(t)}
    assert got == want


def test_replay_batches_hold_their_share(spark):
    pool = lambda p, n: spark.createDataFrame([(f"{p}{k}",) for k in range(n)], "key string")
    rows = curation.replay_batches(pool("f", 5), pool("a", 40), 8, 0.25).collect()
    by = {}
    for x in rows:
        by.setdefault(x.batch, []).append(x)
    assert all(sum(x.pool == "feedback" for x in b) == 2 and len(b) == 8 for b in by.values()) and len(by) == 7
    assert {x.key for x in rows if x.pool == "anchor"} == {f"a{k}" for k in range(40)}


def test_splits_keep_writers_together(spark):
    rows = spark.createDataFrame([(k, f"w{k % 13}") for k in range(100)], "sample_id long, writer_id string")
    for split in (curation.split_by_ratio(rows), curation.split_by_hash(rows)):
        assert split.groupBy("writer_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_recalibrated_costs_keep_the_floor(spark):
    mined = spark.createDataFrame([("substitute", "a", "o", 3), ("substitute", "x", "y", 10_000)], "op string, a string, b string, n long")
    costs = spark.createDataFrame([("o", "a", 0.35), ("e", "c", 0.30)], "a string, b string, cost double")
    got = {(r.a, r.b): (r.previous_cost, r.cost, r.update_count) for r in confusion.recalibrate(mined, costs).collect()}
    assert got[("a", "o")] == (0.35, 0.3001, 3) or abs(got[("a", "o")][1] - 0.3001) < 2e-4
    assert got[("x", "y")][1] == 0.15 and got[("c", "e")] == (0.30, 0.30, 0)


def test_mining_counts_swapped_shapes(spark):
    rows = spark.createDataFrame([("corn flakes", "com flakes"), ("same", "same"), ("cat", "eat")], "prediction string, correction string")
    got = {(r.op, r.a, r.b): r.n for r in confusion.mine(rows).collect()}
    assert got == {("substitute", "m", "rn"): 1, ("substitute", "c", "e"): 1}


def test_validation_gives_every_reason(spark):
    schema = "document_id long, original string, correction string, confidence double, submission_id string, is_demo boolean"
    rows = spark.createDataFrame([(1, "a", "b", 0.5, "s1", False), (None, None, "x" * 501, 1.5, "s 1", True), (2, "a", "b", None, "s2", None)], schema)
    good, bad = feedback.validate(rows)
    assert good.count() == 2
    assert set(bad.first().reasons) == {"blank_document_id", "blank_original", "correction_too_long", "confidence_out_of_range", "bad_submission_id", "demo"}


def test_identifiers(spark):
    rows = spark.createDataFrame([("1234567893", "AB1234563"), ("1234567890", "AB1234567"), ("12", "x"), (None, None)], "npi string, dea string")
    got = [tuple(r) for r in rows.select(safety.npi_valid(F.col("npi")), safety.dea_valid(F.col("dea"))).collect()]
    assert got[:3] == [(True, True), (False, False), (False, False)]


def test_lasa_audit_needs_the_other_name(spark):
    pairs = spark.createDataFrame([("alpha", "alpho")], "drug_a string, drug_b string")
    rows = spark.createDataFrame([(1, 1, "take alpha now", "take alpho now"), (2, 1, "alpha and alpho", "alpho"), (3, 1, "alpha", "alpha")], "doc_id long, line_no long, ref string, hyp string")
    assert [tuple(r)[:4] for r in safety.lasa_audit(rows, pairs).collect()] == [(1, 1, "alpha", "alpho")]


def test_loops_are_cut(spark):
    text = "go on " + " ".join(["so it"] * 8) + " end"
    rows = spark.createDataFrame([(1, 1, text), (1, 2, "short text")], "doc_id long, line_no long, text string")
    got = {r.line_no: (r.text, r.loops) for r in documents.collapse_loops(rows).collect()}
    assert got[1] == ("go on so it so it", 1) and got[2] == ("short text", 0)


def test_repairs(spark):
    texts = ["It ended ... ", "Dear me MARIANB.", "the end , Which", "a plain line", "yours truly Marian B.", "the dog 's bone's s end x", 'he  said "', "MARIANB", None, "Then Paul Said so"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r.text for r in pages.repair(rows).orderBy("k").collect()]
    assert got == ["It ended.", "Dear me. Marian B.", "the end, which", "a plain line", "yours truly. Marian B.", "the dog's bone's end x", "he said", "Marian B.", None, "Then Paul said so"]
    assert [r.fixes for r in pages.repair(rows).orderBy("k").collect()][3] == []


def test_continued_lines(spark):
    page = ["the end of the af-", "ter noon. it was.", "a good day in the", "Big city was bright today", 'And "so it ended']
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(page)], "page int, line int, text string")
    got = [r.fixed for r in pages.continue_lines(rows).orderBy("line").collect()]
    assert got == ["the end of the after", "noon. it was.", "a good day in the", "Big city was bright today.", 'And "so it ended."']


def test_page_cleanup(spark):
    page = ["First we went to the market.", "Ann B.", "x", "First we went to the market.", "zz top", "market day", "edit", "and then First we went to the market. again we bought bread"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(page)], "page long, line long, text string")
    assert [r.line for r in pages.finalize(rows).orderBy("line").collect()] == [0, 1, 5, 7]


def test_noise_lines(spark):
    rows = spark.createDataFrame([("Jump to search",), ("Sorry, I cannot",), ("#a b",), (" ",), (None,), ("A good line",)], "text string")
    assert [r.text for r in pages.noise_filter(rows).collect()] == ["A good line"]


def test_fused_readers(spark):
    a = spark.createDataFrame([(1, "the quick brow"), (2, "same"), (3, "only"), (4, "one two")], "k long, text string")
    b = spark.createDataFrame([(1, "the quick brown"), (2, "same"), (4, "one and two")], "k long, text string")
    got = {r.k: (r.text, r.rule) for r in pages.fuse_readers(a, b, ["k"]).collect()}
    assert got == {1: ("the quick brown", "completed_last_word"), 2: ("same", "same"), 3: ("only", "single"), 4: ("one and two", "recovered_words")}


def test_first_submission_wins(spark):
    schema = "submission_id string, document_id long, line_no long, original string, correction string, confidence double, ts long, event_id long"
    rows = [("s", 1, 1, "a", "b", 0.5, 1, 1), ("s", 1, 1, "a", "b", 0.5, 2, 2), ("s", 1, 1, "a", "c", 0.5, 3, 3)]
    got = feedback.first_submissions(spark.createDataFrame(rows, schema)).first()
    assert (got.replays, got.conflicts) == (1, 1)


def test_rescore_by_phrases_fuzzy_words_and_context(spark):
    beams = ["metoprolo 500mg", "bempedoic acid", "zzzz qqqq wwww", "metoprolol 500mg IV tablet", "xx yy vvvv metoprolo", "xx yy vvvv Metoprolo", "aspirin 30g bid"]
    data = [(k, 0, n, t, p) for k, b in enumerate(beams) for n, (t, p) in enumerate([("qqqqqqqq", 0.0), (b, -1.0)])]
    frame = spark.createDataFrame(data, "doc_id long, line_no int, beam_no int, text string, log_prob double")
    lex = spark.createDataFrame([("metoprolol", 2.0), ("bempedoic acid", 1.0), ("aspirin", 1.0)], "key string, weight double")

    def scores(**more):
        return {x.doc_id: x.score for x in confusion.rescore(frame, lex, weights=(1.0, 0.8, 0.0), **more).collect() if x.beam_no == 1}

    got = scores()
    # the lone first word of weight 1.0 scores 1.5 as a phrase, more than its 1.0 as a word
    want = [-1 + 1.5 * 0.9, -1 + 2.5, -1.0, -1 + 2.0 - 0.8, -1.0, -1 + 1.5 * 0.9, -1 + 1.5 + 0.8 * (0.3 - 1)]
    assert [got[k] for k in range(7)] == pytest.approx(want, abs=1e-4)
    meds = spark.createDataFrame([("metoprolol", [500.0], "PO", 1000.0)], "term string, strengths array<double>, route string, max_dose double")
    fitted = scores(medications=meds)
    assert fitted[0] == pytest.approx(got[0] + 0.8) and fitted[3] == pytest.approx(got[3] + 0.8 * 0.7) and fitted[6] == got[6]


def test_keys_keep_letters_of_all_scripts(spark):
    from scriptorium.functions.text import key_words, word_key

    texts = ["Été,", " mañana!", "Straße-7_b", "«Ωμέγα»", "...", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(word_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == ["été", "mañana", "straße-7_b", "ωμέγα", "", None]
    words = spark.createDataFrame([("L'été  à Paris.",)], "t string").select(key_words(F.col("t")).alias("k")).first().k
    assert words == ["lété", "à", "paris"]
    pairs = spark.createDataFrame([("mañana", "manana")], "drug_a string, drug_b string")
    rows = spark.createDataFrame([(1, 1, "hasta mañana", "hasta manana")], "doc_id long, line_no long, ref string, hyp string")
    assert [(r.expected, r.found) for r in safety.lasa_audit(rows, pairs).collect()] == [("mañana", "manana")]


def test_labels_of_any_type(spark):
    rows = spark.sql(r"""SELECT X'61FFC3A9' AS b, named_struct('z', 'q"a,:b', 'a', cast(null as int)) AS s, array(map('k', 1)) AS m, parse_json('{"y": [1, {"b": ", ", "a": "\\\\"}], "x": true}') AS v,
      true AS t, 12 AS n, cast(null as binary) AS e""")
    got = rows.select(*[T.raw_label(F.col(c), rows.schema[c].dataType).alias(c) for c in rows.columns]).first()
    assert (got.b, got.t, got.n, got.e) == ("a�é", "True", "12", "")
    assert got.s == '{"a": null, "z": "q\\"a,:b"}' and got.m == '[{"k": 1}]' and got.v == '{"x": true, "y": [1, {"a": "\\\\", "b": ", "}]}'


def test_phrases_are_counted_as_they_are_found(spark):
    rng = random.Random(2)
    lines = [(d, n, [rng.choice("abcde") for _ in range(rng.randrange(7))]) for d in range(8) for n in range(6)]
    keys = spark.createDataFrame(lines, "doc_id long, line_no long, keys array<string>")
    tokens = keys.select("doc_id", "line_no", F.posexplode("keys").alias("pos", "key"))
    entries = [("a", "A", 1.0), ("b", "B", 1.5), ("a b", "AB", 2.0), ("c d", "CD", 2.0), ("b a c", "BAC", 2.5), ("a b c d", "ABCD", 3.0), ("e e", "EE", 1.0), ("d e a b c", "five", 9.0)]
    for most in (4, 2):
        known = spark.createDataFrame([e for e in entries if len(e[0].split()) <= most or len(e[0].split()) > 4], "key string, word string, weight double")
        want = lexicon.phrases(tokens, known).groupBy("word", "weight", "n_words").count()
        runs = lexicon.contexts(keys, most)
        got = lexicon.phrase_counts(runs, known, most)
        assert sorted(map(tuple, got.select("word", "weight", "n_words", "n").collect())) == sorted(map(tuple, want.collect()))
        assert runs.count() < tokens.count() and "pos" not in got.columns  # runs meet the entries, not places
