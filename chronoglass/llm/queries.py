"""The corpus operators' queries, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, exact_dedup, html_text, language, license, line_dedup, manifest, packing, pii, quality, simhash, token_files
from .common import LOWER, UPPER, table
from .tokens import public


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are documents; a path has the source, and two levels of directories from the identifier."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), (F.col("doc_id") % 1000 / 100).cast("int").cast("string"), (F.col("doc_id") % 100 / 10).cast("int").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license.scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path), carry=["doc_id"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(pii.of_kind(F.col("base"), i)).cast("long").alias(f"n_{pii.KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_string(F.col("base")), 256).alias("base_sha256"), pii.spans_string(F.col("spans")).alias("spans"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    out = language.identify(docs, language.fit(docs.where(~F.col("held_out"))), carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), width=2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proof is folded from the leaf that the row has after a seventh of the rows had n_chars raised by 1."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest.document_manifest(table(spark, sf_dir, "documents"), altered={"n_chars": tampered})
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), manifest.fold(F.col("other_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), public("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_license, op2_pii, op3_html, op4_lines, op5_exact, op6_language, op7_packing, op8_decontamination, op9_token_files, op10_simhash, op11_manifest, op12_quality, op13_alignment)}

_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_KEY = _LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = {
    "op4_lines": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines
), repeated AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.top, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_exact": f"""
WITH n AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op11_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {_leaf("n_chars")} AS h,
         CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS other
  FROM documents
), nodes AS (
  SELECT lang, 0 AS level, i, n, h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang, level ORDER BY i) AS next FROM nodes WHERE n > 1) WHERE i % 2 = 0
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY level ORDER BY i) AS next FROM tops WHERE n > 1) WHERE i % 2 = 0
), paths AS (
  SELECT l.lang, l.i, list(x.h ORDER BY s.level) AS siblings, list((l.i >> s.level) & 1 ORDER BY s.level) AS bits
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.level = s.level AND x.i = xor(l.i >> s.level, 1) GROUP BY ALL
), top_paths AS (
  SELECT r.lang, list(x.h ORDER BY s.level) AS siblings, list((r.i >> s.level) & 1 ORDER BY s.level) AS bits
  FROM subroots r JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s ON true LEFT JOIN tops x ON x.level = s.level AND x.i = xor(r.i >> s.level, 1) GROUP BY ALL
), whole AS (
  SELECT l.doc_id, l.h AS leaf, r.subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(p.siblings, []) || coalesce(t.siblings, []) AS siblings, coalesce(p.bits, []) || coalesce(t.bits, []) AS bits, l.other AS h, 1 AS k
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i LEFT JOIN top_paths t ON t.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT * FROM whole
  UNION ALL
  SELECT * REPLACE (k + 1 AS k, sha256(CASE WHEN bits[k] = 1 THEN siblings[k] || h ELSE h || coalesce(siblings[k], '') END) AS h) FROM folded WHERE k <= len(bits)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(siblings, lambda x: x IS NOT NULL), '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM folded WHERE k = len(bits) + 1""",
    "op12_quality": f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(text, '')) AS t, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words FROM documents
), lines AS (SELECT r, source, t, unnest(string_split(text, chr(10))) AS line FROM docs
), keyed AS (
  SELECT r, source, t, line, {_LOW.format("regexp_replace(trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g')), '[1-9]', '0', 'g')")} AS key FROM lines
), worded AS (SELECT * FROM keyed WHERE key <> ''
), common AS (
  SELECT k.source, key FROM worded k GROUP BY k.source, key
  HAVING count(DISTINCT t) > {quality.LINE_DOCS} AND count(DISTINCT t) * 100 > {quality.LINE_PERCENT} * (SELECT count(DISTINCT t) FROM docs d WHERE d.source IS NOT DISTINCT FROM k.source)
), lost AS (
  SELECT r, sum(len(string_split(k.key, ' '))) AS n FROM worded k JOIN common c ON c.key = k.key AND c.source IS NOT DISTINCT FROM k.source GROUP BY r
), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r
), grams AS (
  SELECT r, i, words[i : i + {quality.WINDOW - 1}] AS g FROM (SELECT r, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM docs)
), often AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), inside AS (SELECT r, count(DISTINCT i + k) AS n FROM often, range({quality.WINDOW}) AS w(k) GROUP BY r
), counted AS (
  SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(i.n, 0) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lost_words
  FROM docs d LEFT JOIN dup u USING (r) LEFT JOIN inside i USING (r) LEFT JOIN lost l USING (r)
), judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed,
       NOT base_failed AND 100 * (n_words - n_lost_words) >= {quality.LEFT_PERCENT} * n_words AS kept FROM judged""",
}
