"""The contract queries of the training-data operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, html, licenses, lm, minhash, mixing, packing, quality, substring, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mix": op3_source_mix,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_lm_score": op10_lm_score,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_LANGUAGES = ", ".join(f"'{x}'" for x in quality.LANGUAGES)
_RULES = " AND ".join(
    f"(n_words < {r.from_words} OR coalesce({over}::DOUBLE / nullif({under}, 0), 0) BETWEEN {r.low} AND {r.high}"
    + (f" OR (lang NOT IN ({_LANGUAGES}) AND coalesce({over}::DOUBLE / nullif({under}, 0), 0) <= {r.high}))" if over == "n_stop_words" else ")")
    for r in quality.RULES
    for over, under in [quality.METRICS[r.metric]]
)

_TEMPLATES = ", ".join(f"('{name}', ['" + "', '".join(licenses.template_bigrams(text)) + "'])" for name, text in sorted(licenses.TEMPLATES.items()))

ORACLE_SQL = {
    "op5_license_scan": rf"""
WITH n AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
u AS (SELECT rid, doc_id, 'line' AS unit, unnest(range(0, len(l))) AS unit_index, unnest(l) AS words FROM (SELECT *, string_split(norm, chr(10)) AS l FROM n)
  UNION ALL SELECT rid, doc_id, 'paragraph', unnest(range(0, len(p))), unnest(p) FROM (SELECT rid, doc_id, list_filter(regexp_split_to_array(norm, '\n(?:[ ]?\n)+'), lambda x: contains(x, chr(10))) AS p FROM n)
  UNION ALL SELECT rid, doc_id, 'text', 0, norm FROM n WHERE contains(norm, chr(10))),
w AS (SELECT *, list_filter(regexp_split_to_array(words, '[ \n]+'), lambda x: x <> '') AS ws FROM u),
g AS (SELECT rid, doc_id, unit, unit_index, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) >= 2),
t(license, tg) AS (VALUES {_TEMPLATES}),
s AS (SELECT rid, doc_id, unit, unit_index, license, len(list_intersect(grams, tg)) * 2.0::DOUBLE / (len(grams) + len(tg)) AS dice FROM g, t WHERE len(grams) BETWEEN 0.6 * len(tg) AND 1.6 * len(tg)),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, unit, unit_index ORDER BY dice DESC, license) AS k FROM s WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, unit, unit_index, license, dice FROM b WHERE k = 1""",
    "op9_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op2_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len(list_filter(ws, lambda w: lower(w) IN ({_STOP})))::BIGINT AS n_stop_words
  FROM l LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {_RULES}) AS kept, n_lines, n_stop_words FROM f""",
    "op3_source_mix": rf"""
WITH s AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM src),
lv AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS level FROM w),
st AS (SELECT *, row_number() OVER (ORDER BY level, source NULLS LAST) AS at_,
  ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
  / (sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM lv),
cut AS (SELECT arg_min(at_, at_) AS cat, arg_min(share, at_) AS cshare FROM st WHERE share <= level),
t AS (SELECT source, source_size, CASE WHEN at_ < cat THEN cap::DOUBLE ELSE weight * cshare END AS target FROM st, cut),
u AS (SELECT doc_id, source, size, count(*) AS times, md5('{mixing.SEED}:' || doc_id::VARCHAR) AS key FROM s GROUP BY doc_id, source, size),
c AS (SELECT u.*, t.source_size, t.target, sum(u.size * u.times) OVER (PARTITION BY u.source ORDER BY key, doc_id, u.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
e AS (SELECT c.*, copy, (copy * source_size + upto)::DOUBLE / nullif(target, 0) AS finish FROM c, (SELECT unnest([0, 1, 2]) AS copy)),
r AS (SELECT *, sum(size * times) OVER (ORDER BY finish, key, doc_id, source, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e WHERE finish IS NOT NULL),
k AS (SELECT doc_id, source, size, count(*) AS copies FROM r WHERE run <= (SELECT round(sum(target)) FROM t) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM c LEFT JOIN k ON c.doc_id IS NOT DISTINCT FROM k.doc_id AND c.source IS NOT DISTINCT FROM k.source AND c.size = k.size, unnest(range(0, c.times)) AS x(i)""",
    "op6_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t, doc_id) AS k FROM n)
SELECT doc_id, keep_id, group_size, (doc_id = keep_id AND k = 1) AS kept, sha256(t) AS text_sha256 FROM g""",
}
