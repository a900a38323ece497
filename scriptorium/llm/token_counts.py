"""Token counts that follow edits.

A text is cut into leaves at places where the pre-tokenizer always breaks, so counts of leaves add up:
before a single space or line end between letters, digits and punctuation, and between a letter and
punctuation. A document's tree holds characters and tokens as subtree sums, and is stored as such. An
edit re-encodes the leaves it touches, and neighbours as long as the cut beside the edited piece is
no longer such a place, and updates the sums on the way to the root.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import default_encoder

LEAF = 192
_CUT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n](?=[\p{L}\p{N}\p{P}])|(?<=\p{L})(?=\p{P})")
#: Redactions: e-mail addresses, and runs of seven digits or more with single separators. An address starts
#: where its run of characters does, so that long words are read once.
REDACTIONS = ((re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+"), "[email]"), (re.compile(r"\+?\d(?:[ .-]?\d){6,}"), "[number]"))


def leaves_of(text: str, leaf: int = LEAF) -> list[int]:
    """Lengths in characters of a text's leaves; none for an empty text."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + leaf)
        end = cut.start() if cut else len(text)
        out.append(end - at)
        at = end
    return out


class SegmentTree:
    """Sums of (characters, tokens) over leaves, as a complete binary tree in one array: node k has the
    children 2k and 2k + 1, and the second half of the array are the leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars)] = np.array([chars, tokens], np.int64).T if chars else 0
        for level in range(self.width.bit_length() - 2, -1, -1):
            lo = 1 << level
            self.sums[lo : 2 * lo] = self.sums[2 * lo : 4 * lo : 2] + self.sums[2 * lo + 1 : 4 * lo : 2]

    @classmethod
    def stored(cls, nodes: bytes) -> SegmentTree:
        tree = cls.__new__(cls)
        tree.sums = np.frombuffer(nodes, "<i8").reshape(-1, 2).copy()
        tree.width = len(tree.sums) // 2
        return tree

    def nodes(self) -> bytes:
        return self.sums.astype("<i8").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and the leaf's first character; the last one beyond the end."""
        node, before = 1, 0
        char = min(char, int(self.sums[1, 0]) - 1)
        while node < self.width:
            node *= 2
            if char - before >= self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.width, before

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def chars(self, leaf: int) -> int:
        return int(self.sums[leaf + self.width, 0])


def ordered_edits(edits: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str]]:
    """By start; clipped to the text; one that starts before the end of an earlier one is left out."""
    out, end = [], 0
    for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1])):
        start, stop = max(0, min(start, size)), max(0, min(stop, size))
        if start >= end and stop >= start:
            out.append((start, stop, new))
            end = stop
    return out


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], count) -> tuple[str, int]:
    """The edited text, and how many characters were encoded again; ``tree`` is updated.

    Edits are made from the last to the first, so that places before them still hold.
    """
    again = 0
    for start, stop, new in reversed(ordered_edits(edits, len(text))):
        if not text:
            text, again = new, again + len(new)
            tree.set(0, len(new), count(new))
            continue
        first, lo = tree.leaf_at(start)
        last, end = tree.leaf_at(max(start, stop - 1))
        end += tree.chars(last)
        piece = text[lo:start] + new + text[stop:end]
        text = text[:start] + new + text[stop:]
        grown = lo + len(piece)
        # boundary context: widen until both ends are cuts again
        while lo > 0 and not _CUT.match(text, lo):
            first -= 1
            lo -= tree.chars(first)
        total = len(text)
        while grown < total and (grown == lo or not _CUT.match(text, grown)):
            last += 1
            grown += tree.chars(last)
        piece = text[lo:grown]
        again += len(piece)
        # the piece is cut anew over the leaves that it takes, the last of which holds what is left
        sizes = leaves_of(piece)
        room = last - first + 1
        sizes = [*sizes[: room - 1], sum(sizes[room - 1 :])]
        for leaf in range(first, last + 1):
            size = sizes[leaf - first] if leaf - first < len(sizes) else 0
            tree.set(leaf, size, count(text[lo : lo + size]) if size else 0)
            lo += size
    return text, again


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def build_trees(docs: DataFrame, make_encoder=default_encoder) -> DataFrame:
    """doc_id, text_key, n_leaves, n_tokens, nodes: the trees with their subtree sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                keys, leaves, tokens, nodes = [], [], [], []
                for text in piece.column("text").to_pylist():
                    text, place, counts = text or "", 0, []
                    sizes = leaves_of(text)
                    for size in sizes:
                        counts.append(len(encode(text[place : place + size])))
                        place += size
                    tree = SegmentTree(sizes, counts)
                    keys.append(_key(text))
                    leaves.append(len(sizes))
                    tokens.append(tree.tokens)
                    nodes.append(tree.nodes())
                columns = [piece.column("doc_id"), pa.array(keys, pa.int64()), pa.array(leaves, pa.int32()), pa.array(tokens, pa.int64()), pa.array(nodes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_leaves", "n_tokens", "nodes"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_leaves int, n_tokens long, nodes binary")


def find_redactions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, edits of the documents in which a redaction applies."""
    edit = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = [{"start": m.start(), "stop": m.end(), "new": new} for rule, new in REDACTIONS for m in rule.finditer(text or "")]
                if found:
                    rows.append((doc, _key(text), text, found))
            if rows:
                d, k, t, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(t, pa.string()), pa.array(e, edit)], names=["doc_id", "text_key", "text", "edits"])

    return docs.mapInArrow(run, "doc_id long, text_key long, text string, edits array<struct<start:int,stop:int,new:string>>")


def recount(trees: DataFrame, edited: DataFrame, make_encoder=default_encoder) -> DataFrame:
    """doc_id, text_key, n_edits, n_tokens_after, n_chars_again, n_chars: counts after ``edited``'s edits,
    from the stored trees; only the touched pieces of a text are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            after, again, n = [], [], []
            for row in batch.select(["text", "edits", "nodes"]).to_pylist():
                tree = SegmentTree.stored(row["nodes"])
                edits = [(e["start"], e["stop"], e["new"]) for e in row["edits"]]
                _, redone = apply_edits(row["text"], tree, edits, lambda t: len(encode(t)))
                after.append(tree.tokens)
                again.append(redone)
                n.append(len(ordered_edits(edits, len(row["text"]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, pa.int64()) for x in (n, after, again))], names=["doc_id", "text_key", "n_edits", "n_tokens_after", "n_chars_again"])

    edited = edited.withColumnRenamed("doc_id", "e_id").withColumnRenamed("text_key", "e_key")
    same = F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_key") == F.col("e_key"))
    joined = edited.join(trees, same).dropDuplicates(["doc_id", "text_key"])
    joined = joined.select("doc_id", "text_key", "text", "edits", "nodes")
    return joined.mapInArrow(run, "doc_id long, text_key long, n_edits long, n_tokens_after long, n_chars_again long")


def counts_with_redactions(docs: DataFrame, make_encoder=default_encoder) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_leaves, n_tokens, n_edits, n_tokens_after, n_chars_again.

    Null and empty texts have no leaves and count 0. Rows that repeat id and text are counted alike;
    a null id is kept. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trees = materialize(build_trees(rows, make_encoder), "trees")
    after = recount(trees, find_redactions(rows), make_encoder).withColumnsRenamed({"doc_id": "a_id", "text_key": "a_key"})
    before = trees.select("doc_id", "text_key", "n_leaves", "n_tokens")
    joined = before.join(after, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_leaves", "n_tokens", zero("n_edits"), F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"), zero("n_chars_again"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return counts_with_redactions(table(spark, sf_dir, "documents"))
