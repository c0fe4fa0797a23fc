"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_content import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(spark, table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduped_documents

    return deduped_documents(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_html_main_text, op4_toxicity, op5_token_files, op6_url_filter, op7_syncmer_fingerprints, op8_benchmark_decontamination, op9_line_dedup, op10_ngram_jaccard_join, op11_importance_resampling, op12_merkle_manifest, op13_language_id)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of lower-case hex text ``x`` as an expression, with the table ``crc_table(t)`` of the polynomial's bytes.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"""


def _crc_sql(text: str) -> str:
    bytes_ = f"list_transform(range(0, CAST(length(hex(encode({text}))) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(i + 1 AS INTEGER), 2) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bytes_}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT))"


_ENC = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_ENC(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
#: SQL for the operators that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_benchmark_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
  bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw), ns AS (SELECT DISTINCT n FROM bk),
  dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
  h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bk USING (n, k)), p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
  t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY 1)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.c + y.c - i)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
  SELECT d.doc_id, coalesce(any_value(c), 0) AS n_shingles, min(root) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op11_importance_resampling": rf"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2), bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY 1),
  v AS MATERIALIZED (SELECT w, CAST({_crc_sql('w')} % 10000 AS INTEGER) AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
  s AS (SELECT bucket, sum(n) AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN v USING (w) GROUP BY 1), z AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS zs, coalesce((SELECT sum(t) FROM t), 0) AS zt),
  g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (zs + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (zt + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
  x AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
  y AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS UBIGINT) AS h FROM d LEFT JOIN x USING (doc_id)),
  f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM y),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM f WHERE n_features >= 20)
  SELECT f.doc_id, n_features, weight, score, CASE WHEN k <= 10 * (SELECT count(*) FROM r) // 100 THEN k END AS rank FROM f LEFT JOIN r ON f.doc_id = r.doc_id""",
    "op12_merkle_manifest": rf"""WITH RECURSIVE {_CRC_TABLE}, a AS MATERIALIZED (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_LEAF('n_chars + 1')} ELSE {_LEAF('n_chars')} END AS bent FROM documents, crc_table),
  p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM a),
  lv AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
    UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, level, pos // 2),
  top AS (SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM lv WHERE n = 1
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
  nodes AS MATERIALIZED (SELECT tree, level, pos, h, n FROM lv UNION ALL SELECT -1, level, pos, h, n FROM top),
  climb AS (SELECT doc_id, tree AS own, tree, 0 AS level, pos, leaf, '' AS proof, bent AS f FROM p
    UNION ALL SELECT doc_id, own, CASE WHEN m.n > 1 THEN c.tree ELSE -1 END, CASE WHEN m.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN m.n > 1 THEN c.pos // 2 ELSE c.own END, leaf,
      CASE WHEN m.n > 1 THEN proof || coalesce(s.h, '') ELSE proof END, CASE WHEN m.n = 1 THEN f WHEN c.pos % 2 = 1 THEN sha256(coalesce(s.h, '') || f) ELSE sha256(f || coalesce(s.h, '')) END
    FROM climb c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.pos = c.pos LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1) AND m.n > 1 WHERE m.n > 1 OR c.tree >= 0)
  SELECT c.doc_id, leaf, u.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
  FROM climb c JOIN nodes r ON r.tree = -1 AND r.n = 1 AND c.tree = -1 AND c.level = r.level JOIN nodes u ON u.tree = c.own AND u.n = 1""",
}
