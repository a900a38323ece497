"""Ranking of beams at all stages against plain Python over the same components."""

import math
import random

import pytest

from scriptorium.operators import confusion
from scriptorium.operators import lexicon as lexicon_ops

KINDS = "doc_id long, line_no long, beam_no int, text string, top string, log_prob double, lex double, context double, confusion double"


def plain(rows, weights):
    out = {}
    lines = {}
    for r in rows:
        lines.setdefault(r[:2], []).append(r)
    for key, beams in lines.items():
        scored = [(r[5] + weights[0] * r[6] + weights[1] * r[7] - weights[2] * r[8], r) for r in beams]
        top = beams[0][4]
        ranked = sorted(scored, key=lambda x: (-x[0], x[1][2]))
        delta = ranked[0][0] - max(s for s, r in scored if r[3] == top)
        power = [math.exp(max(-20.0, s - ranked[0][0])) for s, _ in ranked]
        share = [max(0.01, min(0.99, p / sum(power))) for p in power]
        if len(beams) == 1:
            share = [1 / (1 + math.exp(-max(-10.0, min(10.0, scored[0][0] + weights[2] * beams[0][8]))))]
        applied = ranked[0][1][3] != top or delta > 0.01
        for k, (s, r) in enumerate(ranked):
            out[(*key, r[2])] = (round(s, 4), k + 1, round(share[k], 4), round(delta, 4), applied, r[3] != top)
    return out


def test_stages_from_one_pass(spark):
    rng, rows = random.Random(6), []
    for line in range(120):
        n = rng.choice([1, 2, 4])
        texts = [rng.choice("abc") for _ in range(n)]
        rows += [(line % 5, line, k, t, texts[0], -0.1 * k - rng.choice([0, 0, 30]), rng.randrange(5) / 2, rng.randrange(-2, 3) / 4, rng.randrange(4) / 8) for k, t in enumerate(texts)]
    ranked = confusion.rank_stages(spark.createDataFrame(rows, KINDS), confusion.ABLATION).collect()
    for stage, weights in confusion.ABLATION.items():
        want = plain(rows, weights)
        got = {(r.doc_id, r.line_no, r.beam_no): (r.score, r["rank"], r.confidence, r.delta, r.applied, r.changed) for r in ranked if r.stage == stage}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][1:2] + got[k][4:] == want[k][1:2] + want[k][4:]
            assert [got[k][i] for i in (0, 2, 3)] == pytest.approx([want[k][i] for i in (0, 2, 3)], abs=1.1e-4)


def test_components_and_report(spark):
    beams = [(1, 1, 0, "corn flakes", -0.1), (1, 1, 1, "com flakes", -0.2), (2, 1, 0, "only", float("nan"))]
    frame = spark.createDataFrame(beams, "doc_id long, line_no long, beam_no int, text string, log_prob double")
    lexicon = spark.createDataFrame([("com", 2.0), ("flakes", 1.0)], "key string, weight double")
    parts = confusion.beam_components(frame, lexicon)
    by = {(r.doc_id, r.beam_no): r for r in parts.collect()}
    assert by[2, 0].log_prob == -1000.0 and by[2, 0].top == "only" and by[2, 0].confusion == 0.0
    assert by[1, 1].top == "corn flakes" and by[1, 1].confusion == pytest.approx(0.25 / 11) and by[1, 1].lex > by[1, 0].lex
    truth = spark.createDataFrame([(1, 1, "com flakes"), (2, 1, "only")], "doc_id long, line_no long, ref string")
    report = {r.stage: r for r in confusion.ablation_report(confusion.rank_stages(parts, confusion.ABLATION), truth).collect()}
    assert (report["baseline"].exact, report["baseline"].applied) == (1, 0)
    assert all((report[s].exact, report[s].applied, report[s].changed) == (2, 1, 1) for s in ("lexicon", "lexicon_confusion", "full"))
    flips = confusion.rank_flips(confusion.rescore(frame, lexicon, weights=(0.0, 0.0, 0.0)), confusion.rescore(frame, lexicon)).collect()
    assert {(r.doc_id, r.flipped) for r in flips} == {(1, 1), (2, 0)}


def test_scores_meet_beams_by_line_and_not_by_text(spark):
    rows = [(1, 1, b, t, -0.1 * b) for b, t in enumerate(["Corn Flokes rn", "corn flakes", None, "com"])]
    frame = spark.createDataFrame(rows, "doc_id long, line_no long, beam_no int, text string, log_prob double")
    lexicon = spark.createDataFrame([("corn", 1.5), ("corn flakes", 1.0), ("flakes", 2.0)], "key string, weight double")
    cheaper = {k: 0.15 for k in confusion.COSTS}
    parts = confusion.beam_components(frame, lexicon, other_costs={"cheaper": cheaper})
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "text#" in x]
    by = {r.beam_no: r for r in parts.collect()}
    # an entry of one word, then one within a letter, which counts 1.5 * 5/6; the fourth beam is two letters from an entry
    assert by[0].lex == pytest.approx(1.5 + 1.25) and by[0].term == "corn" and by[1].lex == 3.5 and by[1].term == "corn flakes"
    assert by[2].lex == 0.0 and by[2].confusion == 0.0 and by[3].term == "corn" and by[3].lex == pytest.approx(0.75)
    assert 0 < by[1].cheaper < by[1].confusion and by[3].cheaper < by[3].confusion
    weights = (0.0, 0.0, 2.0)
    ranked = confusion.rank_stages(parts, {"before": weights, "after": weights}, {"after": "cheaper"})
    plain = confusion.rank_flips(confusion.rescore(frame, lexicon, weights=weights), confusion.rescore(frame, lexicon, cheaper, weights=weights))
    assert confusion.flips(ranked, "before", "after").collect() == plain.collect()


def test_nearest_entries_are_the_first_of_all_near_ones(spark):
    rng = random.Random(6)
    words = lambda n: {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) for _ in range(n)}
    tokens = spark.createDataFrame([(w,) for w in words(150)], "key string")
    entries = spark.createDataFrame([(w, w, rng.choice([1.0, 1.5, 3.0])) for w in words(60)], "key string, word string, weight double")
    want = {(r.token, r.key, r.distance, r.sim) for r in lexicon_ops.fuzzy(tokens, entries).collect() if r["rank"] == 1}
    assert want and {(r.token, r.key, r.distance, r.sim) for r in lexicon_ops.nearest(tokens, entries).collect()} == want
