"""The banded alignment of many pairs against the plain one, mining, and the table functions."""

import random
from collections import Counter

import pytest

from scriptorium.functions.align import align
from scriptorium.functions.multigram import MultigramAligner
from scriptorium.operators import confusion
from scriptorium.plans import flywheel, streams  # noqa: F401  (they register)
from scriptorium.plans.catalog import QUERIES

TABLE = confusion.both_ways(confusion.COSTS)


def lines(n, seed, longest=40):
    rng = random.Random(seed)
    alpha = "rnm iclduvwgaeo 5mcg10×é😀"
    out = []
    for _ in range(n):
        a = "".join(rng.choice(alpha) for _ in range(rng.randrange(longest)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.4:
                b.insert(k, rng.choice("rnm mcg"))
            elif b and rng.random() < 0.5:
                del b[k % len(b)]
            elif k + 1 < len(b):
                b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b).replace("rn", "m") if rng.random() < 0.4 else "".join(b).replace("mcg", "mg")
        out.append((a, b if rng.random() < 0.9 else "".join(rng.choice(alpha) for _ in range(rng.randrange(longest)))))
    return out


@pytest.mark.parametrize("costs", [TABLE, {}, {("ab", "c"): 0.15, ("c", "ab"): 0.15, ("xyz", "q"): 0.2}])
def test_many_pairs_equal_one_by_one(costs):
    pairs = lines(150, 7) + [("", ""), ("", "abc"), ("xyz", "q"), ("ab", "ba"), ("rn", "m")]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    aligner = MultigramAligner(costs)
    cost, steps = aligner.steps(a, b)
    got = {}
    for p, *step in steps.texts(a, b):
        got.setdefault(p, []).append(tuple(step))
    assert (aligner.distances(a, b) == cost).all()
    for k, pair in enumerate(pairs):
        total, plain = align(*pair, costs)
        assert abs(total - cost[k]) < 1e-9
        plain = [(op, s, t) for op, s, t, _ in plain if op != "match"][::-1]
        assert [x[:3] for x in got.get(k, [])] == plain


def test_nothing_to_align():
    cost, steps = MultigramAligner(TABLE).steps([], [])
    assert len(cost) == 0 and steps.texts([], []) == []


def test_mining_and_table_functions_agree(spark):
    pairs = [(p, c) for p, c in lines(60, 9) if p != c] * 2
    plain = Counter()
    for p, c in pairs:
        plain.update((op, min(s, t), max(s, t)) for op, s, t, _ in align(p, c, TABLE)[1] if op != "match")
    rows = spark.createDataFrame([*pairs, ("same", "same"), (None, "x"), ("x" * 1001, "y")], "prediction string, correction string")
    assert {(r.op, r.a, r.b): r.n for r in confusion.mine(rows).collect()} == plain
    confusion.register_align(spark)
    short = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(pairs)] + [(-1, None, "x"), (-2, "x", None)], "id long, a string, b string")
    steps = "op, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n"
    lateral = spark.sql(f"SELECT {steps} FROM (SELECT collect_list(a) p, collect_list(b) c FROM {{rows}} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY id % 7), LATERAL align(p, c) GROUP BY ALL", rows=short)
    table = spark.sql(f"SELECT {steps} FROM align_pairs(TABLE (SELECT id, a, b FROM {{rows}})) GROUP BY ALL", rows=short)
    for found in (lateral, table):
        assert {(r.op, r.a, r.b): r.n for r in found.collect()} == plain
    places = spark.sql("SELECT place, op, source, target FROM (SELECT array('a', null, 'torn') p, array('a', 'b', 'tom') c), LATERAL align(p, c)").collect()
    assert [tuple(r) for r in places] == [(2, "substitute", "rn", "m")]


def test_local_corrections_need_no_table_or_a_small_one(monkeypatch):
    rows, whole = [], MultigramAligner._banded

    def counted(self, a, b, n, m, band, trace):
        rows.append(int(n.max()))
        return whole(self, a, b, n, m, band, trace)

    monkeypatch.setattr(MultigramAligner, "_banded", counted)
    rng = random.Random(4)
    lines = [" ".join("".join(rng.choice(of) for _ in range(rng.randrange(2, 9))) for _ in range(30)) for of in ("etaoinshrdlum", "etaoinrm") for _ in range(2)]
    various = ["".join(chr(rng.randrange(97, 160)) for _ in range(200)) for _ in range(2)]
    walked = [(t.replace("rn", "m").replace("in", "m"), t) for t in lines] + [(t.replace("e", "c"), t) for t in lines]
    cut = [(t[:-2], t) for t in various] + [(t[:100] + "é" + t[101:], t) for t in various]
    aligner = MultigramAligner(TABLE)
    for pairs, most in ((walked, 0), (cut, 100)):
        rows.clear()
        a, b = [p[0] for p in pairs], [p[1] for p in pairs]
        cost, steps = aligner.steps(a, b)
        assert max(rows, default=0) <= most
        got = {}
        for p, *step in steps.texts(a, b):
            got.setdefault(p, []).append(tuple(step[:3]))
        for k, pair in enumerate(pairs):
            total, plain = align(*pair, TABLE)
            assert total == cost[k] and got[k] == [s[:3] for s in plain if s[0] != "match"][::-1]


def test_lines_of_any_length_are_mined(spark, tmp_path):
    """One line of over 1,000 characters, of a corruption each: document 2 has c for e, document 3 has lost its end."""
    line = "the rest were eaten before evening " * 40 + "xyz"
    spark.createDataFrame([(2, line, "en", "s"), (3, line, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("agg13_confusion_mining", "agg14_confusion_recalibrate", "str3_confusion_stream", "udf2_lateral_align")}
    n = line.count("e")
    assert {(r.op, r.a, r.b): r.n for r in found["agg13_confusion_mining"]} == {("substitute", "c", "e"): n, ("insert", "", "y"): 1, ("insert", "", "z"): 1}
    assert {(r.a, r.b): r.update_count for r in found["agg14_confusion_recalibrate"] if r.update_count} == {("c", "e"): n}
    assert [(r.a, r.b, r.update_count) for r in found["str3_confusion_stream"]] == [("c", "e", n)]
    # places 2 * 31 and 3 * 31 by three: ``rn`` for ``m`` with a space lost, and ``rn`` for ``m`` once
    assert {(r.op, r.a, r.b): r.n for r in found["udf2_lateral_align"]} == {("substitute", "m", "rn"): 2, ("delete", "", " "): 1}
