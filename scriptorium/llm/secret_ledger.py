"""Secret scans over a ledger of blobs.

Every historical version of a path is addressed by the SHA-256 of its text, its blob. The ledger
tells which versions of which rules have seen a blob, and what they found there. An update scans only
the pairs of blob and rule version that the ledger lacks, each text once however many paths hold it, and
commits one immutable part by a rename that fails if another update was first. Findings are joined
back to all paths that hold their blob.

Positions need no Python: the matches of a pattern and the pieces between them, one after the other,
are the whole text, so a match starts where the lengths of all before it end.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is Java's; a match counts if ``group`` has ``least`` characters or more. A change of
    either needs a new ``version``. Patterns must not match the empty string."""

    name: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    # the runs of 16 and more among all runs; a shorter one cannot hold a longer one
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}", 16),
)
#: Beyond the base: private key headers, and passwords in the authority of a URL.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", 1, r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@"),
)
_LEDGER = "blob binary, scanned array<string>, findings array<struct<rule:string,version:int,start:int,end:int>>"
_HIT = "array<struct<rule:int,place:int,gap:int,size:int,counted:int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _hits(rule: int, matches: Column, counted: Column, pieces: Column) -> Column:
    """The matches of one rule in order: the characters between it and the one before, its own, and
    those of the group that counts."""
    zipped = F.arrays_zip(matches.alias("m"), counted.alias("c"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"))
    found = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(rule).alias("rule"), i.alias("place"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["c"]).alias("counted")
        ),
    )
    return F.coalesce(F.when(F.size(matches) > 0, found), F.array()).cast(_HIT)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger rows of ``blobs(blob, text, todo)``, where ``todo`` has the keys of the rules to apply."""
    wanted = lambda r: F.array_contains("todo", r.key)
    matched = blobs.select(
        "*", *[F.when(wanted(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{k}") for k, r in enumerate(rules)]
    )
    for k, r in enumerate(rules):
        some = F.size(f"m{k}") > 0
        group = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(f"m{k}")
        matched = matched.withColumns({f"c{k}": F.when(some, group), f"p{k}": F.when(some, F.split("text", r.pattern, -1))})
    hits = F.concat(*[_hits(k, F.col(f"m{k}"), F.col(f"c{k}"), F.col(f"p{k}")) for k in range(len(rules))])
    rows = matched.select("blob", F.col("todo").alias("scanned"), F.explode_outer(hits).alias("h")).select("blob", "scanned", "h.*")
    # a blob's rows stand together since its copies were merged: neither step below moves them
    before = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum(F.col("gap") + F.col("size")).over(before) - F.col("size")).cast("int")
    least = F.array(*[F.lit(r.least) for r in rules])
    spans = rows.withColumn("start", start).withColumn("counts", F.col("counted") >= F.get(least, F.col("rule")))
    span = F.when(F.col("counts"), F.struct("rule", "start", (F.col("start") + F.col("size")).alias("end")))  # nulls are not collected
    one = spans.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.array_sort(F.collect_list(span)).alias("s"))
    names, versions = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    found = F.transform(
        "s",
        lambda x: F.struct(
            F.get(names, x["rule"]).alias("rule"), F.get(versions, x["rule"]).alias("version"), x["start"].alias("start"), x["end"].alias("end")
        ),
    )
    return one.select("blob", "scanned", found.alias("findings"))


class SecretLedger:
    """A ledger in the folder ``root``, which the driver and all executors must share; it need not exist."""

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = BASE + ADDED):
        if len({r.name for r in rules}) < len(rules):
            raise ValueError("the names of rules must differ")
        self.spark, self.root, self.rules = spark, root, tuple(rules)
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}")

    def updates(self) -> list[str]:
        """The committed parts, the oldest first."""
        folder = self._path("parts")
        fs = folder.getFileSystem(self._conf)
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in found if n.isdigit())

    def _commit(self, rows: DataFrame, parts: list[str]) -> str:
        name = f"{int(parts[-1]) + 1 if parts else 1:08d}"
        stage = f".{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/parts/{stage}")
        fs = self._path("parts").getFileSystem(self._conf)
        try:
            renames = self._hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(renames, 1)
            options[0] = renames.NONE
            context = self._hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            context.rename(self._path(f"parts/{stage}"), self._path(f"parts/{name}"), options)
        finally:
            fs.delete(self._path(f"parts/{stage}"), True)  # still there only if the commit failed
        return name

    def read(self) -> DataFrame:
        """blob, scanned, findings: a row for each blob and update that scanned it."""
        parts = [f"{self.root}/parts/{n}" for n in self.updates()]
        if not parts:
            kinds = [field.split(" ", 1) for field in _LEDGER.split(", ")]
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
        return self.spark.read.schema(_LEDGER).parquet(*parts)

    def update(self, history: DataFrame, text_col: str = "text") -> str:
        """Scan what the ledger lacks of ``history``, which holds every version of every path; the name of
        the part that was committed. A null text counts as empty, a text that many rows hold is scanned
        once, and no other column is read. An update without anything new commits an empty part."""
        parts = self.updates()
        keys = F.array(*[F.lit(r.key) for r in self.rules]).cast("array<string>")
        texts = history.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        # copies merge where they are read, so a blob that a third of all rows hold is moved once a task
        blobs = texts.groupBy(blob_of(F.col("text")).alias("blob")).agg(F.first("text").alias("text"))
        if parts:
            seen = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
            blobs = blobs.join(seen.hint("merge"), "blob", "left")
            keys = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, F.col("seen")))
        todo = blobs.select("blob", "text", keys.alias("todo")).filter(F.size("todo") > 0)
        return self._commit(scan_blobs(todo, self.rules), parts)

    def findings(self) -> DataFrame:
        """blob, findings: what the rules, as they stand now, found; a row for each blob with a finding."""
        now = F.array(*[F.lit(r.key) for r in self.rules]).cast("array<string>")
        found = F.filter("findings", lambda x: F.array_contains(now, F.concat_ws("@", x["rule"], x["version"])))
        rows = self.read().select("blob", found.alias("f")).filter(F.size("f") > 0)
        return rows.groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("findings"))

    def report(self, history: DataFrame, path_col: str, text_col: str = "text") -> DataFrame:
        """path, blob, findings for each row of ``history``: array of (rule, version, start, end) by start, then
        in the order of the rules; start and end are code points, end exclusive.

        Null and empty texts have no findings. Repeated rows and rows of one path are all returned, a
        null path too; an empty table gives no rows. Other columns, whatever their names, are not read.
        """
        order = F.array(*[F.lit(r.name) for r in self.rules])
        ranked = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"], F.array_position(order, x["rule"]).alias("k"), x.alias("span"))))
        rows = history.select(F.col(path_col).alias("path"), blob_of(F.col(text_col)).alias("blob"))
        # written first: then both sides of the join are plain shuffles, which Spark splits where many paths hold one blob
        found = materialize(self.findings().select("blob", F.transform(ranked, lambda x: x["span"]).alias("findings")), "findings").hint("merge")
        nothing = F.array().cast("array<struct<rule:string,version:int,start:int,end:int>>")
        return rows.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", nothing).alias("findings"))


def secrets(docs: DataFrame, root: str, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``, through the ledger at
    ``root``: the counts and the digest are of the base rules, the spans of all. Nulls, repeats and
    empty tables as in ``SecretLedger``."""
    ledger = SecretLedger(docs.sparkSession, root, rules)
    ledger.update(docs)
    base = F.array(*[F.lit(r.name) for r in BASE])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    of = F.filter("findings", lambda x: F.array_contains(base, x["rule"]))
    count = lambda name: F.size(F.filter("findings", lambda x: x["rule"] == name)).cast("long").alias(f"n_{name}")
    return ledger.report(docs.select("doc_id", "text"), "doc_id").select(
        F.col("path").cast("long").alias("doc_id"),
        *[count(r.name) for r in BASE],
        F.sha2(text(of).cast("binary"), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
    )


def op11_secret_ledger(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/secrets-{uuid.uuid4().hex}")


def _sql_spans(kind: str, order: int, pattern: str, least: int, group: int = 0) -> str:
    """DuckDB rows of one rule: a match starts after all pieces and matches before it."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS k, i,
    coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM (SELECT doc_id, p, m, g, unnest(generate_series(1, len(m))) AS i
    FROM (SELECT doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g FROM docs))
  WHERE length(g[i]) >= {least}"""


_RULES_SQL = " UNION ALL ".join(_sql_spans(r.name, k, r.pattern.replace("(?<![0-9a-f])", ""), r.least, r.group) for k, r in enumerate(BASE + ADDED))

OP11_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_RULES_SQL}),
spans AS (SELECT doc_id, kind, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM found),
per AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)
"""
