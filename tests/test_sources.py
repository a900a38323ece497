"""Readers on small files in every shape they take."""

import hashlib
import json
import struct

from scriptorium.plans import ingest  # noqa: F401  (it registers)
from scriptorium.plans.catalog import QUERIES
from scriptorium.sources import catalogs, readers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_manifest_shapes(spark, tmp_path):
    one = {"id": "a", "image": "a.png", "clinic": "C", "items": [{"name": "Drug", "strength": "5mg", "instructions": "daily", "disp": "#10"}, ["Other", "1mg", "twice"], ["short"], 7]}
    two = {"sample_id": "b", "id": "z", "text": "seen", "category": "x", "metadata": {"category": "y", "kept": "k"}}
    gone = {"id": "c", "image_path": "c_syn.png"}
    text = "Drug 5mg\nSig: daily\nDisp: #10 Refills: 0\nOther 1mg\nSig: twice\nDisp: #30 Refills: 0"
    shapes = {"list.json": [one, two, gone], "samples.json": {"samples": [one, two, gone]}}
    for name, data in shapes.items():
        got = {r.sample_id: r for r in readers.read_manifest(spark, put(tmp_path / name, json.dumps(data, indent=1)), multi_line=True).collect()}
        assert set(got) == {"a", "b"} and got["a"].full_text == text and got["a"].clinic_name == "C" and len(got["a"]["items"]) == 2, name
        assert got["b"].full_text == "seen" and got["b"].metadata == {"category": "x", "template_category": "y", "kept": "k", "text": "seen"}, name
    single = readers.read_manifest(spark, put(tmp_path / "one.json", json.dumps(two, indent=1)), multi_line=True).collect()
    assert [r.sample_id for r in single] == ["b"]
    lines = readers.read_manifest(spark, put(tmp_path / "m.jsonl", json.dumps(one) + "\n" + json.dumps(gone))).collect()
    assert [r.full_text for r in lines] == [text]
    rows = readers.read_manifest(spark, put(tmp_path / "m.csv", 'id,text,category\nq,"two\nlines ""x""",c\n'), multi_line=True, form="csv").collect()
    assert [(r.sample_id, r.full_text, r.metadata["category"]) for r in rows] == [("q", 'two\nlines "x"', "c")]


def test_line_index_and_forms(spark, tmp_path):
    path = put(tmp_path / "lines.txt", "# c\n\nf1-w9-01 ok 154 19 x 1 2 3 A|move\nf1-w9-02 ok 154 19 1 1 2 3\nshort row\n")
    rows = readers.read_line_index(spark, path)
    assert sorted((r.line_id, r.x, r.text) for r in rows.collect()) == [("f1-w9-01", 0, "A move"), ("f1-w9-02", 1, "")]
    forms = readers.read_forms(spark, put(tmp_path / "forms.txt", "# f\nf1-w9 writer7 2\nbad\n"))
    assert {r.writer for r in readers.with_forms(rows, forms).collect()} == {"writer7"}


def test_labels(spark, tmp_path):
    good, bad = readers.read_private_labels(spark, put(tmp_path / "p.tsv", "a.png\tt\ts\tw\tbox\tTrue\nb.png\tt\n\nc.png\t\ts\tw\tbox\tno\n"))
    assert sorted((r.filename, r.human_corrected) for r in good.collect()) == [("a.png", True), ("c.png", False)] and bad.count() == 1
    rows = readers.read_labels(spark, put(tmp_path / "l.tsv", "a.b.png\tone\ttwo\nnone\n")).collect()
    assert [(r.stem, r.text) for r in rows] == [("a.b", "one\ttwo")]


def test_feedback(spark, tmp_path):
    lines = [{"sample_id": "2", "line_crop": "c", "label": "x"}, {"feedback_id": "1", "transcription": "y"}, {"id": "3", "text": "z", "is_demo": True}, {"id": "4"}]
    path = put(tmp_path / "f.jsonl", "\n".join(map(json.dumps, lines)) + "\n{broken")
    good, bad = readers.read_feedback(spark, path)
    assert sorted((r.feedback_id, r.text) for r in good.collect()) == [("1", "y"), ("2", "x")] and bad.count() == 1
    assert [r.feedback_id for r in readers.read_feedback(spark, path, max_samples=1)[0].collect()] == ["1"]


def test_catalogs(spark, tmp_path):
    meds = {"medications": [{"generic_name": "Alpha", "is_lasa": True, "brand_names": ["Brand A", "beta"]}, {"generic_name": "Beta"}]}
    m = catalogs.read_medications(spark, put(tmp_path / "m.json", json.dumps(meds, indent=1)))
    d = catalogs.read_directions(spark, put(tmp_path / "d.json", json.dumps({"codes": [{"code": "BID", "meaning": "twice"}, {"code": ""}]})))
    c = catalogs.read_clients(spark, put(tmp_path / "c.txt", "# names\n Alpha \nCara\n"), form="text")
    e = catalogs.read_clients(spark, put(tmp_path / "e.json", json.dumps({"names": ["Dora"]})))
    got = {r.key: r for r in catalogs.merge_catalogs(m, d, c, e).collect()}
    assert {k: (r.word, r.weight) for k, r in got.items()} == {"alpha": ("Alpha", 4.0), "brand a": ("Brand A", 1.5), "beta": ("Beta", 2.0), "bid": ("BID", 3.0), "cara": ("Cara", 4.0), "dora": ("Dora", 4.0)}
    assert got["alpha"].metadata == {"type": "client", "is_lasa": "true"} and got["bid"].metadata["meaning"] == "twice"


def test_assets(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 20, 64) + b"x")
    (tmp_path / "b").write_bytes(b"\xff\xd8\xffrest")
    got = {r.format: r for r in readers.asset_inventory(spark, f"file://{tmp_path}/*").collect()}
    assert (got["png"].width, got["png"].height, got["png"].too_small, got["png"].bytes) == (20, 64, True, 25) and not got["jpeg"].too_small


def test_manifest_keeps_blank_texts_and_what_is_unknown(spark, tmp_path):
    """src1_manifest_ingest against its SQL, by hand: texts, languages and sources that are empty or null."""
    rows = [(k, t, lang, src) for k, (t, lang, src) in enumerate((t, lang, src) for t in ("", None, "seen", "\r\n ") for lang in ("en", "de", None) for src in ("web", None, "") for _ in range(6))]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([*rows, (None, "t", "en", "web")], schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.sample_id: tuple(r) for r in QUERIES["src1_manifest_ingest"](spark, str(tmp_path)).collect()}
    want = {}
    for k, text, lang, src in rows:
        if k % 5 != 4:
            rebuilt = None if lang is None or src is None else f"{lang} 5mg\nSig: {src}\nDisp: #30 Refills: {'2' if k % 2 else '0'}"
            digest = None if k % 3 == 0 or text is None else hashlib.md5(text.encode()).hexdigest()
            want[f"d{k}"] = (f"d{k}", f"img/{k}.png", text if k % 3 else rebuilt, lang, None if lang in (None, "en") else "en", src, digest)
    assert got == want


def test_blank_csv_cell_is_an_empty_text(spark, tmp_path):
    rows = readers.read_manifest(spark, put(tmp_path / "m.csv", 'id,text\nq,""\nr,\n'), form="csv").collect()
    assert [(r.sample_id, r.full_text) for r in rows] == [("q", ""), ("r", "")]
