"""The prefix trie of conversations, in shards of double-array tries.

Conversations become sequences of turn keys (SHA-256 of role and text), equal ones are merged and all are
sorted. A shard is a piece of that order, whatever its prefixes are, so a first turn that a third of
all conversations share is cut like any other. Each shard packs BASE and CHECK arrays over the dense ids of
its turns and walks them for its nodes. Nodes on the paths of its first and last sequences may also stand in
the shards before and after: their parts are merged over all shards.

Long conversations are cut into bands of ``BAND`` turns. A band's tries stand on the prefixes before it
and are built from the last band up, as what hangs below a node is part of its totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .double_array import DoubleArray

#: Turns of a band, and of a shard's sequences (of the last sequence somewhat more).
BAND = 512
SHARD_TURNS = 100_000
#: Characters of the lists of ids that are joined before they meet in one task.
PIECE = 1 << 16


def turn_order(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, at (from 0), key, bytes, total of all turns.

    All rows are sorted as one, and each task numbers what it has: a conversation that spans several
    tasks is numbered from the counts of those before, so none meets in one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    ).filter("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select("conv", "key", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    spans = rows.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("conv")
    before = F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    spans = spans.select("conv", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(of).alias("total"))
    return rows.join(spans, ["conv", "part"]).select("conv", (F.col("row") + F.col("shift")).alias("at"), "key", "bytes", "total")


def rebuilt(turns: DataFrame, stride: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv, at, key, bytes) of the rebuilt turns, and (conv, size) of all conversations.

    Conversation c starts with the first h turns of c - c % stride and goes on with its own after
    its first h; h is crc32(c) % most.
    """
    h = F.when(F.col("conv") % stride == 0, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    convs = turns.filter("at = 0").select("conv", "total", (F.col("conv") - F.col("conv") % stride).alias("lender"), h.alias("h"))
    totals = convs.select(F.col("conv").alias("lender"), F.col("total").alias("lent"))
    convs = convs.join(totals, "lender", "left").withColumn("k", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = materialize(convs.select("conv", "lender", "h", "k", (F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size")), "convs")
    own = turns.join(convs.select("conv", "h", "k"), "conv").filter("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "key", "bytes")
    # a lender has fewer than ``most`` turns to lend, to fewer than 2 * stride others
    heads = turns.filter((F.col("at") < most) & (F.col("conv") % stride == 0)).select(F.col("conv").alias("lender"), "at", "key", "bytes")
    lent = heads.join(convs.filter("k > 0").select("lender", "conv", "k"), "lender").filter("at < k").select("conv", "at", "key", "bytes")
    return own.union(lent), convs.select("conv", "size")


def _bands(turns: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """conv, band, root, end, more, chunk: the turns of a band as an array, the digests of the prefixes before
    and after it, and whether the conversation goes on."""
    band = F.floor(F.col("at") / width).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("at", "key", "bytes")))
    chunks = turns.groupBy("conv", band.alias("band")).agg(F.transform(listed, lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("chunk"))
    nothing = F.array().cast(chunks.schema["chunk"].dataType)
    chunks = materialize(chunks.union(sizes.filter("size = 0").select("conv", F.lit(0), nothing)), "chunks")
    digest = lambda x: F.unhex(F.sha2(x, 256))
    own = digest(F.array_join(F.transform("chunk", lambda x: F.hex(x["key"])), "").cast("binary"))
    # a digest for each band, not a turn
    lists = chunks.select("conv", "band", own.alias("own")).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("band", "own"))).alias("own"))
    start = F.array(F.lit(b""))
    chain = F.aggregate("own", start, lambda ends, x: F.concat(ends, F.array(digest(F.concat(F.element_at(ends, -1), x["own"])))))
    ends = lists.select("conv", chain.alias("ends")).select("conv", "ends", F.posexplode(F.slice("ends", 2, F.size("ends"))).alias("band", "end"))
    ends = ends.select("conv", "band", F.get("ends", F.col("band")).alias("root"), "end", (F.col("band") + 2 < F.size("ends")).alias("more"))
    return chunks.join(ends, ["conv", "band"]).select("conv", "band", "root", "end", "more", "chunk")


@dataclass
class _Rows:
    """The rows of a shard, in order."""

    root: list
    codes: list
    keys: list
    sizes: list
    n: list
    conv: list
    root_conv: list
    end: list
    below: list


def _rows(table_: pa.Table) -> _Rows:
    col = {name: table_.column(name).to_pylist() for name in ("root", "n", "conv", "root_conv", "end", "kids", "leaves", "saved")}
    chunk = table_.column("chunk").combine_chunks()
    turns = chunk.flatten()
    coded = pc.dictionary_encode(pc.struct_field(turns, "key"))  # the shard's dense turn ids
    flat, sizes = coded.indices.to_pylist(), pc.struct_field(turns, "bytes").to_pylist()
    ends = chunk.offsets.to_pylist()
    cut = [(a - ends[0], b - ends[0]) for a, b in zip(ends, ends[1:], strict=False)]
    dictionary = coded.dictionary.to_pylist()
    by_code = dict(zip(flat, sizes, strict=True))
    below = list(zip(col["kids"], col["leaves"], col["saved"], strict=True))
    return _Rows(col["root"], [flat[a:b] for a, b in cut], dictionary, [by_code[c] for c in range(len(dictionary))], col["n"], col["conv"], col["root_conv"], col["end"], below)


_NODE = pa.schema(
    [("shared", pa.bool_()), ("key", pa.binary()), ("parent", pa.binary()), ("conv", pa.int64()), ("level", pa.int32()), ("parent_conv", pa.int64()), ("n", pa.int64()),
     ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("bytes", pa.int64()), ("end", pa.binary()), ("above", pa.list_(pa.binary()))]
)
_NODE_SQL = (
    "shared boolean, key binary, parent binary, conv long, level int, parent_conv long, n long, kids long, leaves long, saved long, bytes long, end binary, above array<binary>"
)


def _shard(rows: _Rows) -> pa.RecordBatch:
    """The nodes of one double-array trie; those that other shards may hold are marked shared, and their totals
    leave out what belongs to shared nodes below."""
    roots: dict[bytes, int] = {}
    paths = [[roots.setdefault(r, len(roots)), *c] for r, c in zip(rows.root, rows.codes, strict=True)]
    trie = DoubleArray(paths)
    slots = len(trie.check)
    n, level, size = [0] * slots, [0] * slots, [0] * slots
    conv, end, above_conv = [None] * slots, [None] * slots, [None] * slots
    kids, leaves, saved = [0] * slots, [0] * slots, [0] * slots
    key: dict[int, bytes] = {}  # of shared nodes; that of a band's root is the digest of the prefix before it
    top: dict[int, bytes] = {}
    above: dict[int, list[bytes]] = {}
    for k, path in enumerate(paths):
        states = trie.walk(path)[1:]
        edge = k in (0, len(paths) - 1)
        for depth, s in enumerate(states):
            if not n[s]:
                level[s], conv[s] = depth, rows.conv[k]
                if depth:
                    size[s] = rows.sizes[path[depth]]
                else:
                    top[s] = rows.root[k]
                if depth == 1:
                    above_conv[s] = rows.root_conv[k]
            n[s] += rows.n[k]
            conv[s] = min(conv[s], rows.conv[k])
            if edge and s not in key:
                up = states[depth - 1] if depth else None
                key[s] = top[s] if up is None else hashlib.blake2b(key[up] + rows.keys[path[depth]], digest_size=16).digest()
                above[s] = [*(above[up] if up is not None else ()), key[s]]
        last = states[-1]
        end[last] = rows.end[k]
        kids[last] += rows.below[k][0]
        leaves[last] += rows.below[k][1]
        saved[last] += rows.below[k][2]
    out = []
    for s in reversed(trie.states[1:]):  # children before parents
        up = trie.check[s]
        shared = s in key
        if not shared:
            leaves[s] += not kids[s]
            saved[s] += (n[s] - 1) * size[s]
            kids[up] += 1
            leaves[up] += leaves[s]
            saved[up] += saved[s]
        parent = key.get(up) if level[s] and (shared or level[s] > 1) else None
        if not shared and level[s] > 1 and parent is None:
            above_conv[s] = conv[up]
        out.append((shared, key.get(s, top.get(s)), parent, conv[s], level[s], above_conv[s], n[s], kids[s], leaves[s], saved[s], size[s], end[s], above.get(s)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE, strict=True)], schema=_NODE)


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                turns += len(part.column("chunk").flatten())
                if turns >= shard_turns:
                    yield _shard(_rows(pa.Table.from_batches(held)))
                    held, turns = [], 0
        if held and (whole := pa.Table.from_batches(held)).num_rows:
            yield _shard(_rows(whole))

    return run


def _band_nodes(rows: DataFrame, shard_turns: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a band and its roots: (conv, level, parent_conv, n, kids, leaves, saved, end) and, for
    its roots, with their digests as ``key``."""
    order = ["root", "chunk"]
    found = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(shard_turns), _NODE_SQL), name)
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    same = [F.max(c).alias(c) for c in ("parent", "level", "bytes", "end", "above", "parent_conv")]  # equal in all shards, or null
    parts = materialize(found.filter("shared").groupBy("key").agg(*sums, *same, F.min("conv").alias("conv")), name)
    more = parts.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    parts = parts.join(more, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    given = parts.select(
        F.explode("above").alias("key"),
        (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    totals = given.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parts = materialize(parts.drop("leaves", "saved").join(totals, "key"), name)
    parents = parts.select(F.col("key").alias("parent"), F.col("conv").alias("found"))
    columns = ["conv", "level", "n", "kids", "leaves", "saved", "end"]
    known = F.coalesce("parent_conv", "found").alias("parent_conv")
    inner = parts.filter("level > 0").join(parents, "parent", "left").select(*columns, known)
    own = found.filter("not shared")
    hung = own.filter("parent is not null").join(parents, "parent", "left").select(*columns, known)
    lone = own.filter("parent is null and level > 0").select(*columns, "parent_conv")
    roots = parts.filter("level = 0").select("key", *columns).union(own.filter("level = 0").select("key", *columns))
    return inner.union(hung).union(lone), roots


def _ends(rows: DataFrame) -> DataFrame:
    """(end, digest) of ``rows(end, conv)``: SHA-256 of the ids in ascending order, joined by commas.

    Pieces of a list are joined where its rows lie after one sort; a node at which a third of all
    conversations end reaches the last task as pieces, and passes through it as a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, place, part, out = None, [], 0, 0, None, []
        for batch in batches:
            for end, conv, part in zip(*(batch.column(c).to_pylist() for c in ("end", "conv", "part")), strict=True):
                if held and (end != last or size >= PIECE):
                    out.append((last, part, place, ",".join(held)))
                    held, size, place = [], 0, place + 1
                last = end
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) >= 1000 or size >= PIECE:
                yield _pieces(out)
                out = []
        if held:
            out.append((last, part, place, ",".join(held)))
        yield _pieces(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            for end, text in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if end == last:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = end, hashlib.sha256()
                state.update(text.encode())
            yield _pairs(out)
            out = []
        if state is not None:
            out.append((last, state.hexdigest()))
        yield _pairs(out)

    rows = rows.repartitionByRange("end", "conv").sortWithinPartitions("end", "conv").withColumn("part", F.spark_partition_id())
    pieces = rows.mapInArrow(join, "end binary, part int, place int, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "part", "place").mapInArrow(digest, "end binary, digest string")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["end", "part", "place", "ids"])


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["end", "digest"])


def prefix_trie(turns: DataFrame, sizes: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``turns(conv, at, key, bytes)`` of the conversations
    ``sizes(conv, size)``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``at`` counts a conversation's turns from 0 without gaps; one without turns is a member of the root. An
    empty table gives no rows.
    """
    rows = materialize(_bands(turns, sizes, band), "rebuilt")
    sequences = rows.groupBy("band", "end").agg(
        F.first("root").alias("root"), F.first("chunk").alias("chunk"), F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("more").alias("more")
    )
    sequences = materialize(sequences, "sequences")
    last, least = sequences.agg(F.max("band"), F.min("conv")).first()
    out, below = None, None
    for k in range(last or 0, -1, -1):
        part = sequences.filter(F.col("band") == k)
        if below is not None:
            part = part.join(below, "end", "left")
        else:
            part = part.select("*", *[F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        if k:
            tops = sequences.filter((F.col("band") == k - 1) & F.col("more")).select(F.col("end").alias("root"), F.col("conv").alias("root_conv"))
            part = part.join(tops, "root")
        else:
            part = part.withColumn("root_conv", F.lit(least).cast("long"))
        part = part.select("root", "chunk", "n", "conv", "root_conv", "end", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "leaves", "saved")])
        nodes, roots = _band_nodes(part, shard_turns, f"band{k}")
        nodes = nodes.withColumn("depth", F.col("level") + k * band)
        if k:
            below = roots.select(F.col("key").alias("end"), "kids", "leaves", "saved")
        else:
            top = roots.select("conv", "level", "n", "kids", "leaves", "saved", "end", F.lit(None).cast("long").alias("parent_conv"), F.lit(0).alias("depth"))
            nodes = nodes.unionByName(top)
        out = nodes if out is None else out.unionByName(nodes)
    lists = _ends(rows.filter("not more").select("end", "conv"))
    out = materialize(out, "nodes")
    ended = out.filter("end is not null").join(lists, "end", "left").drop("end")
    out = ended.unionByName(out.filter("end is null").drop("end").withColumn("digest", F.lit(None).cast("string")))
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, rebuild: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **sizes
) -> DataFrame:
    """The nodes of ``prefix_trie`` over conversations as they are or, by ``rebuild``, as ``rebuilt`` makes them.

    Turns stand by ``turn``, null first, and those of one number by the digest of role and text; rows that
    repeat are turns of their own. A null role or text counts as empty, and rows without a conversation's id
    belong to none. Other columns are not read.
    """
    turns = turn_order(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild:
        return prefix_trie(*rebuilt(turns), **sizes)
    return prefix_trie(turns.drop("total"), turns.filter("at = 0").select("conv", F.col("total").alias("size")), **sizes)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(x ORDER BY place) AS l FROM t GROUP BY conv_id),
heads AS (SELECT conv_id, l, {_CRC32} % 9 AS h FROM lists),
convs AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.l, 1, c.h), []), list_slice(c.l, c.h + 1, len(c.l))) AS l
  FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, l, d, list_slice(l, 1, d) AS p FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM convs)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d) AS ends
  FROM members GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (
  SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(p[d].text)) END AS saved
  FROM nodes n LEFT JOIN kids k USING (p)),
sums AS (
  SELECT m.p, CAST(count(*) FILTER (f.kids = 0) AS BIGINT) AS n_leaves, CAST(sum(f.saved) AS BIGINT) AS saved_tokens
  FROM full_nodes f JOIN members m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY m.p)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.p = f.p LEFT JOIN nodes u ON f.d > 0 AND u.p = list_slice(f.p, 1, f.d - 1)
"""
