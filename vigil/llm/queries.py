"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (decontaminate, fim, host_rules, html_extract, license_scan, line_dedup, merkle, minmax_dedup,
                       pii, quality_bt, sp_tokens, substring_dedup, token_files)
from vigil.llm.common import table

#: SentencePiece model that op7 and the pipeline encode with.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=13)
            .select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, their digest, and whether they decode to the text, per document."""
    out = sp_tokens.encode(table(spark, sf_dir, "documents"), model_bytes(), with_text=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                      F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"), F.col("same").alias("round_trip"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "item_hash")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.per_document(docs, license_scan.find_licenses(docs))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_classifier, op3_pii, op4_minhash_near_dedup, op5_substring_dedup, op6_html_extraction,
    op7_sentencepiece, op8_benchmark_decontamination, op9_license_scan, op10_host_rules, op11_merkle_manifest,
    op12_token_files, op13_fill_in_middle)}

def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
                 for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    return rf"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS uid, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS cut,
         xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                         lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT uid, doc_id, source, leaf, CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END AS bent,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM rows
), tree(g, lvl, pos, digest, n) AS (
  SELECT g, 0, place, leaf, n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 3, n
), subroots AS (SELECT g, digest AS subroot FROM tree WHERE n = 1
), top(lvl, pos, digest, n) AS (
  SELECT 0, g, subroot, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n
), whole AS (  -- the groups' tree stands above every group's own, from level 100 on
  SELECT g, lvl, pos, digest, n FROM tree UNION ALL SELECT -1, 100 + lvl, pos, digest, n FROM top
), sides AS (
  SELECT g, lvl, pos,
         coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM whole WHERE n > 1
), climb(uid, grp, g, lvl, pos, own, proof) AS (
  SELECT uid, g, CASE WHEN n > 1 THEN g ELSE -1 END, CASE WHEN n > 1 THEN 0 ELSE 100 END, CASE WHEN n > 1 THEN place ELSE g END, bent, '' FROM leaves
  UNION ALL
  SELECT c.uid, c.grp, CASE WHEN t.n = 1 THEN -1 ELSE c.g END, CASE WHEN t.n = 1 AND c.lvl < 100 THEN 100 ELSE c.lvl + 1 END,
         CASE WHEN t.n = 1 AND c.lvl < 100 THEN c.grp ELSE c.pos // 3 END, sha256(s.lft || c.own || s.rgt), c.proof || s.lft || s.rgt
  FROM climb c JOIN sides s ON s.g = c.g AND s.lvl = c.lvl AND s.pos = c.pos
       JOIN whole t ON t.g = c.g AND t.lvl = c.lvl + 1 AND t.pos = c.pos // 3
), ends AS (SELECT uid, arg_max(own, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM climb GROUP BY uid)
SELECT doc_id, source, place, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, proof_sha256, folded_root,
       folded_root = (SELECT digest FROM top WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (g) JOIN ends USING (uid)
"""


ORACLE: dict[str, str] = {"op5_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13)
), firsts AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN firsts USING (h) WHERE m < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
""", "op10_host_rules": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM docs WHERE len(w) >= 5)
), twice AS (SELECT doc_id, h FROM windows GROUP BY doc_id, h HAVING count(*) > 1
), hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM (
  SELECT doc_id, unnest(range(p, p + 5)) AS i FROM windows JOIN twice USING (doc_id, h)) GROUP BY doc_id
), rules AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM docs LEFT JOIN hit USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars AS rule_failed FROM rules
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE rule_failed) AS DOUBLE) AS failed FROM judged GROUP BY source
), total AS (SELECT sum(n) AS n, count(*) AS k, least(greatest(sum(failed) / sum(n), 1e-4), 1 - 1e-4) AS m, sum(n * n) AS n2 FROM hosts
), spread AS (
  SELECT any_value(m) AS m, (sum(h.n * pow(h.failed / h.n - t.m, 2)) / any_value(t.n) - any_value(m * (1 - m) * (k - 1) / t.n))
         / greatest(1 - any_value(n2 / t.n) / any_value(t.n), 1e-9) AS v FROM hosts h, total t
), prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1e4) ELSE 1e4 END AS s FROM spread)
SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (h.failed + m * s) / (h.n + s) < 0.5 AS kept, round((h.failed + m * s) / (h.n + s), 6) AS host_rate
FROM judged j JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source, prior
""", "op11_merkle_manifest": _merkle_sql(), "op13_fill_in_middle": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM docs
), parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""}
