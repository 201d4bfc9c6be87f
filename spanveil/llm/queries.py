"""Queries that apply each operator, with production parameters, to its whole table, and their SQL where there is one."""

from __future__ import annotations

from spanveil.llm.common import table
from spanveil.llm.licenses import by_document, scan_licenses
from spanveil.llm.linededup import line_dedup
from spanveil.llm.media import media_columns
from spanveil.llm.mixing import mix_sources
from spanveil.llm.neardup import near_duplicates
from spanveil.llm.quality import quality_rules
from spanveil.llm.segment import sample_segmentations
from spanveil.llm.sharding import shard_rows
from spanveil.llm.toxicity import score_toxicity
from spanveil.llm.urlfilter import judge_urls


def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_media_columns(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("first_failed")


def op4_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_feistel_shards(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return by_document(scan_licenses(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark, sf_dir):
    return sample_segmentations(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_media_columns,
        op3_quality_rules,
        op4_toxicity,
        op5_mix_sources,
        op6_feistel_shards,
        op7_license_scan,
        op8_line_dedup,
        op9_url_filter,
        op10_sentencepiece,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op3_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS t(i)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
q AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY doc_id),
x AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(q.n, 0)::BIGINT AS n_repeat_words,
  len(string_split(text, chr(10))) AS n_lines,
  len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS caps,
  len(regexp_extract_all(text, '(?m)^[ \\t]*[-*•]')) AS bullets
  FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * letters < 60 * word_chars OR 100 * bullets > 90 * n_lines OR 100 * caps > 60 * word_chars) AS kept
FROM b
""",
    "op5_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
k AS (SELECT *, row_number() OVER u AS k, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER p, 0) AS num, 2 * (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS den
  FROM w WINDOW u AS (ORDER BY source_size / w, source IS NULL, source), p AS (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(num, k) AS num, min_by(den, k) AS den, min(k) AS k FROM k WHERE num * w <= 2 * source_size * den),
t AS (SELECT source, source_size, CASE WHEN k.k >= f.k THEN (k.w * f.num)::DOUBLE / f.den::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target FROM k, f),
a AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.passes, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN 2 * upto - own <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT r, i, l[i] AS line, {_LOWER.format("trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key),
g AS (SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN g ON d.r = g.r
""",
    "op9_url_filter": """
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)://(.*)', 1), '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
r(h, p, v, k) AS (VALUES ('org', '/', 'allow', 1), ('example.org', '/es/', 'block', 2), ('example.org', '/en/1', 'block', 3), ('com', '/fr/', 'allow', 4), ('com', '/de/', 'block', 5)),
m AS (SELECT page_id, min_by(r.h || r.p, -100 * length(r.h || r.p) + k) AS rule, min_by(v, -100 * length(r.h || r.p) + k) AS v FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, CASE WHEN host LIKE '%spam%' OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' OR path LIKE '%/ads/%' OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id
""",
}
