"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scriptorium.llm import conversation_trie as m
from scriptorium.llm.double_array import DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string, key string, at int"


def plain(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), key, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = (convs.get(c - c % 5, [])[:h] + own[h:]) if rebuild else own
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, of in members.items():
        worth = (len(of) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += p not in kids
    key = lambda r: (r[1], r[0], r[7])
    return sorted(
        ((of[0], len(p), members[p[:-1]][0] if p else None, len(of), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
         for p, of in members.items()), key=key
    )


def built(spark, rows, **kw):
    out = m.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    return sorted(map(tuple, out), key=lambda r: (r[1], r[0], r[7]))


def talk(seed, convs, words="abc"):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        hot = c % 3 == 0  # a third of all start alike, a third of those are copies
        for t in range(rng.randrange(1, 14)):
            text = "hello" if hot and (t == 0 or c % 9 == 0) else rng.choice(words) * rng.randrange(3)
            rows.append((c, t, "user" if t % 2 else "assistant", text + ("é" if t == 3 else ""), "x", 0))
    return rows


@pytest.mark.parametrize(("band", "shard"), [(512, 100_000), (3, 40)])
def test_nodes_equal_plain_prefixes(spark, band, shard):
    rows = talk(1, 120)
    rows += [(None, 1, "user", "lost", "", 0), (200, None, None, None, "", 0), (200, 1, "user", None, "", 0), (200, 1, "user", None, "", 0)]
    rows += [(200, 1, "user", "tie", "", 0), (-3, 0, "user", "negative", "", 0), (203, 5, "", "a", "", 0), (204, None, "user", "hello", "", 0)]
    rows = [r for r in rows if r[0] != 25]  # an absent lender
    assert any(c is not None and not c < 0 for c in {r[0] for r in rows})
    want = [r for r in plain([r for r in rows if r[0] is None or r[0] >= 0])]
    assert built(spark, [r for r in rows if r[0] is None or r[0] >= 0], rebuild=True, band=band, shard_turns=shard) == want


def test_long_and_plain_conversations(spark):
    rows = [(c, t, "u", f"{t if t < 40 else (t, c % 4)}", "", 0) for c in range(12) for t in range(90)]
    assert built(spark, rows, band=7, shard_turns=50) == plain(rows, rebuild=False)
    assert built(spark, []) == [] and built(spark, [(None, 1, "u", "a", "", 0)]) == []
    only = [(3, 0, "u", "a", "", 0)]  # its head is absent: a root with a member and no turn
    assert zlib.crc32(b"3") % 9 > 0 and built(spark, only, rebuild=True) == plain(only) and len(plain(only)) == 1


def test_lists_of_ids_meet_as_pieces(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 50)
    rows = [(c, 0, "u", "same", "", 0) for c in range(500)] + [(c, 0, "u", f"{c}", "", 0) for c in range(500, 520)]
    assert built(spark, rows) == plain(rows, rebuild=False)


def test_double_array_holds_its_sequences_and_no_others():
    rng = random.Random(5)
    for size, codes in ((1, 2), (300, 4), (400, 300)):
        kept = sorted({tuple(rng.randrange(codes) for _ in range(rng.randrange(6))) for _ in range(size)})
        trie = DoubleArray([list(s) for s in kept])
        prefixes = {s[:d] for s in kept for d in range(len(s) + 1)}
        assert len(trie.states) == len(set(trie.states)) == len(prefixes)
        for s in prefixes:
            at = trie.walk(list(s))[-1]
            assert {c for c in range(codes) if trie.step(at, c) >= 0} == {p[-1] for p in prefixes if p and p[:-1] == s}
        assert size < 100 or trie.density() > 0.9
