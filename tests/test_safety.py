"""Name audits against plain regular expressions, and the release decision rule by rule."""

import random
import re

import pytest

from scriptorium.operators import safety

PAIRS = [("Alpha", "Alpine"), ("co-zola", "co zolin"), ("a a", "b"), ("été", "ete"), ("Alpha", "co-zola")]


def plain_audit(rows, pairs):
    out = set()
    for doc, line, ref, hyp in rows:
        for a, b in {(a, b) for p in pairs for a, b in (p, p[::-1])}:
            find = lambda n, t: len(re.findall(r"\b" + re.sub(r"\W+", r"\\W+", n) + r"\b", t or "", re.I))
            ar, br, ah, bh = find(a, ref), find(b, ref), find(a, hyp), find(b, hyp)
            names = tuple(" ".join(re.findall(r"\w+", n.lower())) for n in (a, b))
            if ar and not br and bh:
                out.add((doc, line, *names, "substituted"))
            elif ar and br and ah < ar and bh > br:
                out.add((doc, line, *names, "multiple"))
    return out


@pytest.mark.parametrize("most", [safety.AUTOMATON_NAMES, 2])
def test_audit_equals_plain_expressions(spark, most):
    rng = random.Random(4)
    words = ["alpha", "ALPINE,", "co-zola", "Co zola", "co", "zolin;", "a", "a", "b", "été", "ete", "alphas", "x"]
    texts = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8)))
    rows = [(k % 50, k, texts(), texts()) for k in range(400)] + [(1, 900, None, "alpha"), (1, 901, "alpha", None), (1, 902, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, ref string, hyp string")
    found = safety.lasa_audit(df, spark.createDataFrame(PAIRS, "drug_a string, drug_b string"), most=most)
    got = [tuple(r) for r in found.collect()]
    want = plain_audit(rows, PAIRS)
    assert len(got) == len(set(got)) and set(got) == want and {"substituted", "multiple"} == {r[4] for r in want}
    none = safety.lasa_audit(df, spark.createDataFrame([], "drug_a string, drug_b string"), most=most)
    assert none.count() == 0 and safety.lasa_audit(df.limit(0), spark.createDataFrame(PAIRS, "drug_a string, drug_b string"), most=most).count() == 0


def test_coverage_needs_one_name_without_the_other(spark):
    rows = spark.createDataFrame([("Alpha and b",), ("alpine alpha",), ("co zola!",), (None,)], "ref string").selectExpr("ref", "'' as hyp")
    pairs = spark.createDataFrame(PAIRS[:2], "drug_a string, drug_b string")
    assert tuple(safety.lasa_coverage(rows, pairs).first()) == (4, 2)


def test_digest_names_a_set_of_rows(spark):
    digest = lambda rows: spark.createDataFrame(rows, "a long, b string").repartition(3).agg(safety.frozen_digest("a", "b").alias("d")).first().d
    rows = [(1, "x"), (2, None), (3, ""), (1, "x")]
    assert digest(rows) == digest(rows[::-1]) and digest([]) is None
    assert len({digest(rows), digest(rows[:3]), digest([*rows[:3], (1, None)]), digest([*rows[:3], (None, "1x")])}) == 4


def report(**change):
    good = {"role": "candidate", "run": "r", "split": "s", "measured": True, "manifest_hash": "m", "sample_count": 10, "cer": 0.1, "failures": 0, "checkpoint": "ship",
            "checkpoint_hash": "h", "domain": "clinical", "covered": 4, "required": 4, "audited": 10, "lasa_violations": 0}
    return good | change


SCHEMA = "role string, run string, split string, measured boolean, manifest_hash string, sample_count long, cer double, failures long, checkpoint string, checkpoint_hash string, domain string, covered long, required long, audited long, lasa_violations long"
CASES = [
    ({}, {}, None), ({"measured": None}, {}, "unmeasured"), ({"sample_count": 0}, {}, "unmeasured"), ({"manifest_hash": ""}, {}, "unmeasured"),
    ({}, {"measured": False}, "baseline_not_on_same_split"), ({}, {"manifest_hash": "other"}, "baseline_not_on_same_split"), ({}, {"sample_count": 9}, "baseline_not_on_same_split"),
    ({}, {"split": "other"}, "baseline_not_on_same_split"), ({"cer": float("nan")}, {}, "invalid_rate"), ({}, {"cer": float("inf")}, "invalid_rate"), ({"cer": -0.1}, {}, "invalid_rate"),
    ({"failures": 1}, {}, "failures"), ({}, {"failures": 2}, "failures"), ({"checkpoint_hash": None}, {}, "missing_checkpoint_hash"), ({"covered": 3}, {}, "incomplete_coverage"),
    ({"required": 0, "covered": 0}, {}, "incomplete_coverage"), ({"audited": 0}, {}, "incomplete_coverage"), ({"domain": "general", "covered": None}, {}, None),
    ({"checkpoint": "runs\\scratch"}, {}, "forbidden_checkpoint"), ({"cer": 0.1051}, {}, "rate_regression"), ({"cer": 0.105}, {}, None), ({"lasa_violations": 1}, {}, "lasa_violations"),
]


def test_release_by_the_first_reason(spark):
    rows = []
    for k, (candidate, base, _) in enumerate(CASES):
        own = {"run": str(k), "split": f"s{k}"}
        rows += [report(**own | candidate), report(role="baseline", **{"split": f"s{k}"} | base)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    found = safety.release_gate(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)).collect()
    assert {int(r.run): r.reason for r in found} == {k: want for k, (_, _, want) in enumerate(CASES)}
    assert all(r.promote == (r.reason is None) for r in found)
    strict = spark.createDataFrame([tuple(r[n] for n in names) for r in (report(), report(role="baseline"))], SCHEMA)
    assert safety.release_gate(strict, strict=True).first().reason == "not_below_baseline"


def test_template_checks(spark):
    rows = [(1, "a", "Take {drug} {dose}", ["drug", "dose"]), (2, "a", "{x}", ["y"]), (3, "b", None, None), (4, "b", "no slot", None), (5, None, "{z}", None)]
    templates = spark.createDataFrame(rows, "template_id long, category string, text string, slots array<string>")
    minimums = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1), ("d", 0)], "category string, least int")
    got = {r.check: (r.failures, r.passed) for r in safety.template_qa(templates, minimums).collect()}
    assert got == {"slots_declared": (2, False), "category_minimum": (2, False)}
    assert all(r.passed for r in safety.template_qa(templates.limit(0), minimums.limit(0)).collect())
