"""The derived views as DuckDB common table expressions."""

from __future__ import annotations

#: DuckDB's levenshtein compares bytes. The letters of the tables' four languages beyond ASCII become control
#: characters, which no line holds, so that a character is a byte.
ACCENTED = "ÀÁÂÄÇÈÉÊÍÑÓÖÚÜßàáâäçèéêíñóöúü"
_PLAIN = " || ".join(f"chr({k})" for k in [*range(1, 32), 127][: len(ACCENTED)])


def distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{ACCENTED}', {_PLAIN}), translate({b}, '{ACCENTED}', {_PLAIN}))"


#: name: (views it uses, body)
VIEWS: dict[str, tuple[str, str]] = {
    "lines": (
        "",
        r"""SELECT doc_id, line_no, lang, source, text FROM (
  SELECT doc_id, lang, source, generate_subscripts(p, 1) - 1 AS line_no,
    trim(regexp_replace(regexp_replace(unnest(p), '[\x00-\x1F\x7F]', '', 'g'), ' +', ' ', 'g')) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents)) WHERE text <> ''""",
    ),
    "ref_hyp": (
        "lines",
        """SELECT doc_id, line_no, lang, source, text AS ref, CASE (doc_id * 31 + line_no) % 5 WHEN 0 THEN text
  WHEN 1 THEN replace(replace(text, 'rn', 'm'), 'in', 'm') WHEN 2 THEN replace(text, 'e', 'c')
  WHEN 3 THEN CASE WHEN length(text) > 4 THEN left(text, length(text) - 2) ELSE text END ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS hyp FROM lines""",
    ),
    "scored": (
        "ref_hyp",
        f"""SELECT *, {distance("ref", "hyp")} AS edits, length(ref) AS ref_chars, {distance("lower(ref)", "lower(hyp)")} AS edits_uncased FROM ref_hyp""",
    ),
    "stage_hyp": (
        "ref_hyp",
        """SELECT 1 AS stage_no, doc_id, line_no, ref, hyp FROM ref_hyp
  UNION ALL SELECT 2, doc_id, line_no, ref, CASE WHEN lower(hyp) = lower(ref) THEN ref ELSE hyp END FROM ref_hyp
  UNION ALL SELECT 3, doc_id, line_no, ref, CASE WHEN lower(hyp) = lower(ref) OR (doc_id * 31 + line_no) % 5 = 2 THEN ref ELSE hyp END FROM ref_hyp
  UNION ALL SELECT 4, doc_id, line_no, ref, ref FROM ref_hyp""",
    ),
    "samples": (
        "",
        """SELECT d.doc_id AS sample_id, 'w' || (d.doc_id % 97) AS writer_id, d.source, d.lang AS category, coalesce(l.toxic = 1, false) AS is_lasa, d.text, d.lang AS language
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""",
    ),
    "tokens": (
        "lines",
        r"""SELECT doc_id, line_no, pos, regexp_replace(lower(trim(tok)), '[^\pL\pN_\s-]', '', 'g') AS key, tok FROM (
  SELECT doc_id, line_no, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS tok FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM lines))
  WHERE regexp_replace(lower(trim(tok)), '[^\pL\pN_\s-]', '', 'g') <> ''""",
    ),
    "lexicon": (
        "tokens",
        """SELECT key, max(word) AS word, max(weight) AS weight FROM (
  SELECT key, key AS word, CASE WHEN count(*) >= 200 THEN 3.0 WHEN count(*) >= 50 THEN 2.0 ELSE 1.5 END AS weight FROM tokens
    WHERE length(key) >= 2 GROUP BY key HAVING count(*) >= 20
  UNION ALL SELECT DISTINCT p_name, p_name, 2.0 FROM part
  UNION ALL SELECT DISTINCT lower(p_type), lower(p_type), 1.0 FROM part) GROUP BY key""",
    ),
    "pairs": (
        "tokens",
        """SELECT drug_a, drug_b FROM (SELECT key AS drug_a, lead(key) OVER (ORDER BY n DESC, key) AS drug_b, row_number() OVER (ORDER BY n DESC, key) AS r
  FROM (SELECT key, count(*) AS n FROM tokens WHERE length(key) >= 4 AND regexp_matches(key, '^[a-z]+$') GROUP BY key)) WHERE r % 2 = 1 AND r <= 40 AND drug_b IS NOT NULL""",
    ),
    "swapped": (
        "ref_hyp pairs",
        """SELECT doc_id, line_no, lang, source, ref, coalesce(trim(replace(' ' || hyp || ' ', ' ' || drug_a || ' ', ' ' || drug_b || ' ')), hyp) AS hyp
  FROM ref_hyp LEFT JOIN (SELECT row_number() OVER (ORDER BY drug_a) - 1 AS pair, drug_a, drug_b FROM pairs) p ON doc_id % 20 = pair""",
    ),
    "words": (
        "lines",
        """SELECT doc_id, line_no // 20 AS page_no, line_no, word_no, text, CASE WHEN h % 11 = 0 THEN NULL ELSE (h % 1000) / 1000.0::DOUBLE END AS confidence FROM (
  SELECT doc_id, line_no, generate_subscripts(w, 1) - 1 AS word_no, unnest(w) AS text FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM lines)) t,
  LATERAL (SELECT ('0x' || substr(md5(doc_id || ':' || line_no || ':' || word_no), 1, 8))::BIGINT AS h)""",
    ),
    "feedback": (
        "lines",
        """SELECT 's' || (event_id // 2) AS submission_id, user_id AS document_id, k AS line_no, l.text AS original,
  CASE WHEN event_id % 3 = 0 THEN l.text ELSE replace(l.text, 'e', 'c') END AS correction, value / 100 AS confidence, ts, event_type = 'error' AS is_demo, event_id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e LEFT JOIN lines l ON l.doc_id = e.user_id AND l.line_no = e.k""",
    ),
    "boxes": (
        "",
        """SELECT l_orderkey AS page, l_linenumber AS box_no, l_discount * 9 AS ymin, l_tax * 8 AS xmin, (l_quantity - 5) / 40 AS ymax, (l_suppkey % 12) / 10.0::DOUBLE AS xmax FROM lineitem""",
    ),
    "steps": (
        "",
        """SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS step, CASE WHEN l_returnflag = 'N' THEN 'baseline' ELSE 'accelerated' END AS mode,
  l_quantity AS t_data, l_discount * 100 AS t_transfer, l_tax * 100 AS t_fwd, l_quantity / 2 AS t_bwd, l_discount * 50 AS t_opt, l_linenumber AS num_samples, l_extendedprice AS mem, l_shipdate AS ts FROM lineitem""",
    ),
    "epochs": (
        "",
        """SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch, o_totalprice / 1000 AS train_loss, o_totalprice / 900 AS val_loss,
  round((o_orderkey % 50) / 100.0::DOUBLE, 2) AS val_cer FROM orders""",
    ),
}


def with_views(names: list[str], sql: str) -> str:
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in done:
            uses, body = VIEWS[name]
            for other in uses.split():
                need(other)
            done[name] = body

    for name in names:
        need(name)
    sql = sql.strip()
    if not done:
        return sql
    views = ",\n".join(f"{n} AS ({b})" for n, b in done.items())
    return f"WITH {views},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views}\n{sql}"
