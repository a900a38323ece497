"""The secret ledger against Python's own regular expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import secret_ledger as m

TEXTS = [
    None,
    "",
    "nothing here",
    'Password = "abcdefghijkl" and AKIA1234567890ABCD é 0123456789abcdef',
    "token: password: abcdefghijklmn",  # the failing match takes the keyword of the second
    "secret=abc",
    "api_key:'AAAA.bbbb-cccc_dddd' APIKEY=xxxxxxxxxxxx",
    "AKIASHORT AKIAAKIA1234567890 XAKIA12345678901234",
    "deadbeef" * 5000,
    "é" * 3 + "token==" + "x" * 12,
    "-----BEGIN RSA PRIVATE KEY----- see https://user:pass@host/",
    "퟿😀 passwd = 😀 passwd=0123456789ab",
    ("token = 0123456789abcdef0123 " * 300).strip(),
]
RULES = [(r.name, r.pattern, r.least, r.group) for r in m.BASE + m.ADDED]


def plain(text):
    text, out = text or "", []
    for k, (name, pattern, least, group) in enumerate(RULES):
        pattern = "[0-9a-f]+" if name == "hex" else pattern
        for x in re.finditer(pattern, text, re.ASCII):
            if len(x.group(group)) >= least:
                out.append((x.start(), k, f"{name}:{x.start()}:{x.end()}"))
    out.sort()
    base = [s for _, k, s in out if k < 3]
    return (
        *[sum(s.startswith(n) for s in base) for n in ("assign", "access", "hex")],
        hashlib.sha256(",".join(base).encode()).hexdigest(),
        ",".join(s for _, _, s in out),
    )


def history(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, blob string, rule int")


def test_spans_equal_plain_matches(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None), (3, TEXTS[3], "y", 2), (3, TEXTS[6], "y", 2)]
    got = m.secrets(history(spark, rows), f"file://{tmp_path}/ledger").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    want = sorted(((i, *plain(t)) for i, t, _, _ in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    rows = [(1, TEXTS[3], "", 0), (2, TEXTS[3], "", 0), (3, "plain", "", 0)]
    root = f"file://{tmp_path}/ledger"
    ledger = m.SecretLedger(spark, root, m.BASE)
    first = ledger.update(history(spark, rows))
    scanned = lambda part: sorted((bytes(r.blob).hex(), tuple(r.scanned)) for r in spark.read.schema(m._LEDGER).parquet(f"{root}/parts/{part}").collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert scanned(first) == sorted((sha(t), ("assign@1", "access@1", "hex@1")) for t in (TEXTS[3], "plain"))
    # the same again scans nothing; a new blob, only itself
    assert scanned(ledger.update(history(spark, rows))) == []
    assert [b for b, _ in scanned(ledger.update(history(spark, rows + [(4, "new", "", 0)])))] == [sha("new")]
    # a new version of a rule rescans that rule alone, and its old findings go
    narrow = m.Rule("hex", 2, r"(?<![0-9a-f])[0-9a-f]{32,}", 32)
    later = m.SecretLedger(spark, root, (*m.BASE[:2], narrow))
    assert {k for _, k in scanned(later.update(history(spark, rows)))} == {("hex@2",)}
    report = {r.path: [f.rule for f in r.findings] for r in later.report(history(spark, rows), "doc_id").collect()}
    assert report == {1: ["assign", "access"], 2: ["assign", "access"], 3: []}
    assert {f.rule for r in ledger.report(history(spark, rows), "doc_id").collect() for f in r.findings} == {"assign", "access", "hex"}


def test_empty_history_and_lost_race(spark, tmp_path):
    assert m.secrets(history(spark, []), f"file://{tmp_path}/empty").collect() == []
    ledger = m.SecretLedger(spark, f"file://{tmp_path}/race")
    assert ledger.read().count() == 0 and ledger.report(history(spark, [(1, "a", "", 0)]), "doc_id").count() == 1
    ledger._commit(ledger.read(), [])
    with pytest.raises(Exception, match="(?i)exist"):
        ledger._commit(ledger.read(), [])  # another update was first
    assert ledger.updates() == ["00000001"]


def test_no_python_in_the_plan(spark, tmp_path):
    out = m.secrets(history(spark, [(1, TEXTS[3], "", 0)]), f"file://{tmp_path}/plan").select(F.col("doc_id"), "spans")
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
