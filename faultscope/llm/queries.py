"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultscope.llm import bpe, conversations, decontaminate, exact, html, merkle, minhash, packing, pii, quality, substring, suffix, warc
from faultscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@_query("op7_decontaminate", r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM bw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hit AS (SELECT r, s, dg.n AS n, item_id FROM dg JOIN bg ON dg.gram = bg.gram AND dg.n = bg.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


@_query("op1_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM g WHERE gram IN (SELECT gram FROM g GROUP BY 1 HAVING count(*) > 1)),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
         ANTI JOIN gone ON gone.r = x.r AND gone.p = x.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


@_query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


@_query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: right('000' || bin(strpos('0123456789abcdef', hex[k]) - 1), 4)), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + 16 * CAST(bits[5 * k + 1] AS INTEGER) + 8 * CAST(bits[5 * k + 2] AS INTEGER) + 4 * CAST(bits[5 * k + 3] AS INTEGER)
             + 2 * CAST(bits[5 * k + 4] AS INTEGER) + CAST(bits[5 * k + 5] AS INTEGER)]), '') AS payload_digest,
       CASE WHEN page_id = keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_query("op6_minhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), size=4)


@_query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@_query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def _merkle_sql(levels: int = 7) -> str:
    """The manifest as SQL: ``levels`` levels of runs of eight above the documents and above the languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 bit by bit: a byte (plus 256) is added, then eight shifts follow.
    bits = "flatten(list_transform(range(1, length(d) + 1), lambda k: [256 + ascii(d[k]), 0, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, x: {step}), 4294967295::BIGINT)"
    parts = [f"""docs AS (SELECT *, row_number() OVER () AS r, coalesce('=' || lang, '') AS grp, CAST(doc_id AS VARCHAR) AS d FROM documents),
leaves AS (SELECT r, doc_id, grp, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END AS changed FROM docs),
a0 AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY grp) AS n, r FROM leaves)"""]

    def tree(p: str) -> None:
        for k in range(levels):
            parts.append(f"""{p}{k + 1} AS (SELECT grp, idx // 8 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (n + 7) // 8 AS n FROM {p}{k} WHERE n > 1 GROUP BY grp, idx // 8, n)""")
            parts.append(f"""{p}w{k} AS (SELECT grp, idx, coalesce(string_agg(h, '') OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
       coalesce(string_agg(h, '') OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {p}{k} WHERE n > 1)""")
        parts.append(f"{p}top AS (" + " UNION ALL ".join(f"SELECT grp, h FROM {p}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    def way(p: str, source: str, grp: str, idx: str) -> str:
        """Fold ``folded`` and lengthen ``proof`` along the tree, level by level."""
        for k in range(levels):
            parts.append(f"""{source}{p}{k} AS (SELECT s.* REPLACE (CASE WHEN w.idx IS NULL THEN folded ELSE sha256(w.l || folded || w.r) END AS folded, proof || coalesce(w.l || w.r, '') AS proof)
FROM {source if k == 0 else f'{source}{p}{k - 1}'} s LEFT JOIN {p}w{k} w ON w.grp = s.{grp} AND w.idx = s.{idx} // {8**k})""")
        return f"{source}{p}{levels - 1}"

    tree("a")
    parts.append("b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, h, count(*) OVER () AS n, grp AS name FROM atop)")
    tree("b")
    parts.append("""start AS (SELECT doc_id, leaf, l.grp, '' AS one, a0.idx, b0.idx AS place, b0.h AS subroot, (SELECT h FROM btop) AS root, coalesce(changed, leaf) AS folded, '' AS proof
FROM leaves l JOIN a0 USING (r) JOIN b0 ON b0.name = l.grp)""")
    last = way("b", way("a", "start", "grp", "idx"), "one", "place")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"""


@_query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@_query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@_query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))
