"""The pipeline and its stages against plain ones, with nulls, repeated rows, empty tables and clashing names."""

import math
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import low, plain_components, words

from scriptorium.llm import common, exact_dedup, mixing, ngram_join, packing, toxicity

#: Names that the operators use for columns of their own.
CLASHING = ["c0", "c1", "id", "sha", "gone", "score", "evidence", "mix_id", "mix_shard", "mix_order", "mix_part", "gram", "key", "part", "arrival"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def row(doc, text, source="src0"):
    return (doc, text, None, source, None, *[f"{c}{doc}" for c in CLASHING])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    bad = ["vile", "awful", "nasty", "rotten"]
    texts = []
    for k in range(360):
        w = words(r, r.randrange(12, 60), 3000).split()
        if k % 4 == 0:
            w[5:5] = r.sample(bad, 3)
        texts.append(" ".join(w))
    base = words(r, 120)
    texts += [base, base.upper(), base, None, None, "", " \n\t ", "one", "word " * 3000]
    for k in range(8):
        copy = base.split()
        copy[9 * k + 3] = f"edit{k}"
        texts.append(" ".join(copy))
    return [row(3 * k, t, None if k % 11 == 0 else f"src{k % 3}") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], None, int(n % 4 == 0)) for n, r in enumerate(rows[:360])], "doc_id long, quality int, toxic int")


def key(r):
    return tuple(r)


def test_scores_are_those_of_all_examples(docs, labels, rows):
    """Neighbours by a plain scan of all examples, over the terms that the index holds."""
    index = toxicity.fit(docs, labels)
    texts = {r[0]: r[1] for r in rows}
    examples = [int(d) for d in index.ids]
    df = Counter(t for d in examples for t in set(toxicity.terms_of(texts[d])))
    assert all(n >= toxicity.LEAST_EXAMPLES for t, n in df.items() if t in index.vocabulary)

    def vector(text):
        tf = Counter(t for t in toxicity.terms_of(text) if t in index.vocabulary)
        w = {t: (1 + math.log(n)) * math.log(len(examples) / df[t]) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    known = [vector(texts[d]) for d in examples]
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for d, text in texts.items():
        v = vector(text)
        cosines = np.array([sum(x * u.get(t, 0.0) for t, x in v.items()) for u in known])
        near = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEIGHBOURS]
        near = near[cosines[near] > 0]
        if len(near) == toxicity.NEIGHBOURS and np.isclose(np.sort(cosines)[-toxicity.NEIGHBOURS - 1], cosines[near[-1]]):
            continue  # a tie at the edge may go either way by rounding
        vote = float((cosines[near] * index.labels[near]).sum() / cosines[near].sum()) if len(near) else math.nan
        assert got[d] == pytest.approx(index.score(vote), abs=1e-9)


def test_stages_keep_whole_rows(spark, docs, labels, rows, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    by = {key(r): r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        got = [key(r) for r in out.collect()]
        assert got and set(got) <= set(by), name
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0, name
    assert packing.pack(docs.limit(0)).count() == 0


def test_exact_stage(docs, rows):
    best = {}
    for r in rows:
        best[low(r[1])] = max(best.get(low(r[1]), r), r, key=lambda x: x[0])
    assert sorted(key(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(best.values())


def test_exact_stage_keeps_one_of_repeated_rows(spark, rows):
    twice = spark.createDataFrame([*rows, *rows, row(None, "lone"), row(None, "lone")], SCHEMA)
    got = exact_dedup.drop_exact_duplicates(twice).collect()
    assert len(got) == len({low(r[1]) for r in rows}) + 1 and len({low(r.text) for r in got}) == len(got)


def test_near_stage(docs, rows):
    want = plain_components(rows, 5, 80)
    got = sorted(r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect())
    assert got == sorted(d for d, (_, part) in want.items() if d == part)


def test_near_stage_leaves_ambiguous_ids(spark):
    r = random.Random(5)
    base, other = words(r, 60, 900), words(r, 60, 900)
    frame = spark.createDataFrame([row(1, base), row(2, base + " x"), row(2, other), row(3, base + " y"), row(4, None), row(None, base)], SCHEMA)
    assert sorted((x.doc_id or 0, x.text or "") for x in ngram_join.drop_near_duplicates(frame).collect()) == sorted([(1, base), (2, base + " x"), (2, other), (4, ""), (0, base)])


def test_mixing_stage(docs, rows):
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    plan = mixing.plan_mix(docs).toPandas()
    want = {r.doc_id: len(r.mix_shards) for r in plan.itertuples()}
    taken = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert taken == Counter({d: n for d, n in want.items() if n})
    total = sum(size.values())
    # targets by resharing until none is above twice its source
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    words_of = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight, left, target = dict(zip(sources, (3, 1, 2, 3), strict=True)), 1.5 * total, {}
    while True:
        free = [s for s in sources if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * words_of[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 2.0 * words_of[s]
        left = 1.5 * total - sum(target.values())
        if len(target) == len(sources):
            break
    names = {r[0]: r[3] for r in rows}
    for r in plan.itertuples():
        assert r.target == pytest.approx(target[names[r.doc_id]]) and r.size == size[r.doc_id] and r.source_size == words_of[names[r.doc_id]]
    for s in sources:
        got = sum(size[d] * n for d, n in taken.items() if names[d] == s)
        assert abs(got - target[s]) <= max(size[d] for d in size if names[d] == s) / 2 + 1


def test_mixing_repeated_ids_alike(spark):
    r = random.Random(2)
    data = [row(k % 40, words(r, r.randrange(5, 50)), f"src{k % 3}") for k in range(120)]
    frame = spark.createDataFrame(data, SCHEMA)
    once = sorted((x.doc_id, x.text, x.mix_shard) for x in mixing.mix(frame).collect())
    assert once == sorted((x.doc_id, x.text, x.mix_shard) for x in mixing.mix(frame.repartition(7)).collect())
    times = Counter((d, t) for d, t, _ in once)
    assert max(times.values()) <= 2
    assert all(len({times[x[0], x[1]] for x in data if (x[0], x[3]) == (d, s)}) == 1 for d, s in {(x[0], x[3]) for x in data})


def test_run(spark, docs, labels, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scratch = Path(common.scratch_dir(spark).removeprefix("file://"))
    before = {f.name for f in scratch.iterdir()}
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    left = {f.name for f in scratch.iterdir()} - before
    assert not {n for n in left if n.startswith("stage-")}, "the stages' rows are dropped"
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    kept = [r for r in rows if r[0] not in toxic]
    best = {}
    for r in kept:
        best[low(r[1])] = max(best.get(low(r[1]), r), r, key=lambda x: x[0])
    kept = list(best.values())
    parts = plain_components(kept, 5, 80)
    kept = [r for r in kept if parts[r[0]][1] == r[0]]
    frame = spark.createDataFrame(kept, SCHEMA)
    times = {r.doc_id: len(r.mix_shards) for r in mixing.plan_mix(frame).collect()}
    encode = packing.default_encoder()
    want = {r[0]: times[r[0]] * (len(encode(r[1] or "")) + 1) for r in kept if times[r[0]]}
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want


def test_scratch_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("K", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Elsewhere)
    assert common.settle(lambda: spark.range(3).withColumn("x", F.lit(1)), "settled").count() == 3
