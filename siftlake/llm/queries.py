"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import (collocations, compression_classifier, decontamination, language_model, lexical_search, license_scan, mixing, near_dup,
                          quality_rules, token_counts, token_files, url_filter, vector_search)
from siftlake.llm.common import read

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE["op1_quality_rules"] = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda w: w <> '') AS ws FROM docs),
places AS (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS pos FROM words WHERE len(ws) >= 3),
windows AS (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, ws[pos], ws[pos + 1], ws[pos + 2]) AS n FROM places),
covered AS (SELECT DISTINCT row_id, pos + unnest([0, 1, 2]) AS pos FROM windows WHERE n > 1),
repeats AS (SELECT row_id, count(*) AS n_repeat_words FROM covered GROUP BY row_id),
line_rows AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM words),
line_sums AS (SELECT row_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, sum(strlen(line)) AS line_bytes,
    list_sum(list_transform(list_distinct(list(line)), lambda x: strlen(x))) AS distinct_bytes
  FROM line_rows WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY row_id),
figures AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(line_bytes, 0) AS line_bytes, coalesce(distinct_bytes, 0) AS distinct_bytes,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(ws, lambda w: w = '|')) AS bars,
  length(regexp_replace(text, '[^!?]', '', 'g')) AS marks,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
  length(regexp_replace(text, '[\x00-@\[-`{-\x7f]', '', 'g')) AS letters
  FROM words w LEFT JOIN repeats USING (row_id) LEFT JOIN line_sums USING (row_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 5 * n_words OR 10 * bars > 2 * n_words OR 10 * marks > 5 * n_words
    OR 10 * upper > 6 * letters OR 10 * letters < 3 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR 10 * (line_bytes - distinct_bytes) > 3 * line_bytes) AS kept
FROM judged
"""


@query
def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op3_near_duplicates"] = r"""
WITH RECURSIVE word_lists AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS pos FROM word_lists WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


@query
def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                       public_tokenizers.PATTERN)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.where("part = 0").drop("text_key")  # SQL has one row for an item of any length


ORACLE["op8_contaminated"] = r"""
WITH doc_words AS (SELECT doc_id, md5(coalesce(text, '')) AS version,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
docs AS (SELECT DISTINCT doc_id, version, ws, len(ws) AS n FROM doc_words),
item_words AS (SELECT item_id,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
items AS (SELECT item_id, ws, len(ws) AS size, least(5, len(ws)) AS k FROM item_words WHERE len(ws) > 0),
item_grams AS (SELECT item_id, size, k, array_to_string(ws[pos:pos + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS pos FROM items)),
sizes AS (SELECT DISTINCT k FROM items),
doc_grams AS (SELECT doc_id, version, n, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, n - k + 2)) AS pos FROM docs, sizes)),
starts AS (SELECT DISTINCT doc_id, version, n, item_id, size, i.k, greatest(0, least(pos - 1, n - size)) AS st
  FROM doc_grams d JOIN (SELECT DISTINCT item_id, size, k, gram FROM item_grams) i ON d.k = i.k AND d.gram = i.gram),
held AS (SELECT s.doc_id, s.version, s.item_id, s.size, s.k, s.st, d.gram, count(*) AS times
  FROM starts s JOIN doc_grams d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.version = d.version AND s.k = d.k
    AND d.pos > s.st AND d.pos <= s.st + s.size - s.k + 1 GROUP BY ALL),
wanted AS (SELECT item_id, gram, count(*) AS times FROM item_grams GROUP BY ALL),
sums AS (SELECT h.doc_id, h.version, h.item_id, size, k, st, sum(h.times) AS windows, sum(least(h.times, coalesce(w.times, 0))) AS common
  FROM held h LEFT JOIN wanted w ON h.item_id IS NOT DISTINCT FROM w.item_id AND h.gram = w.gram GROUP BY ALL),
hits AS (SELECT *, common / (windows + size - k + 1 - common) AS similarity FROM sums
  WHERE common * 100 >= (windows + size - k + 1 - common) * 80)
SELECT doc_id, item_id, 0::INTEGER AS part, similarity::DOUBLE AS similarity, st::INTEGER AS "start", (windows + 4)::INTEGER AS n_words
FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, version, item_id ORDER BY similarity DESC, st) = 1
"""


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


ORACLE["op9_mix_sources"] = r"""
WITH docs AS (SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS hash FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2.0::DOUBLE * source_size AS lim FROM sizes),
weighted AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight FROM ranked),
ratios AS (SELECT *, lim / weight AS ratio FROM weighted),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () -
      coalesce(sum(lim) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ratios),
held AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM held) = 0 THEN lim
    ELSE least(lim, (SELECT level FROM held) * weight) END AS target FROM levels),
parts AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS copies FROM targets),
rests AS (SELECT *, target - copies * source_size AS rest FROM parts),
ties AS (SELECT source, hash, sum(size) AS words FROM docs GROUP BY source, hash),
sums AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM ties),
edges AS (SELECT s.source, min(struct_pack(hash := hash, upto := upto, words := words)) AS edge
  FROM sums s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE upto > rest GROUP BY s.source)
SELECT doc_id, size, r.source_size, target,
  (size * (copies + CASE WHEN edge IS NULL THEN 0 WHEN hash < edge.hash THEN 1
    WHEN hash = edge.hash AND edge.upto - rest < rest - (edge.upto - edge.words) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""


@query
def op10_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(read(spark, sf_dir, "documents"))


@query
def op11_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op11_top_vectors"] = r"""
WITH whole AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE["op12_lexical_search"] = r"""
WITH doc_terms AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS ts FROM documents),
stats AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM doc_terms WHERE len(ts) > 0),
item_terms AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term FROM benchmark),
tfs AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(ts) AS n, unnest(ts) AS term FROM doc_terms)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, stats),
scores AS (SELECT item_id, row_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN tfs USING (term), stats GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')) AS piece FROM docs),
word_lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
places AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos FROM word_lists, sizes WHERE len(ws) >= m),
counts AS (SELECT lang, m, ws[pos:pos + m - 1] AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM word_lists GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a FROM counts WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (SELECT c.lang, c.m, c.phrase, a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals USING (lang) JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[1:k]
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:c.m]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, phrase, a, m, unnest(range(1, m)) AS pos FROM candidates WHERE m > 2),
inner_parts AS (SELECT lang, a, m, phrase, pos, unnest(range(pos + 1, m + 1)) AS till FROM starts),
around AS (SELECT lang, phrase[pos:till] AS phrase, max(a) AS longer FROM inner_parts WHERE till - pos + 1 < m GROUP BY ALL),
remaining AS (SELECT b.*, array_to_string(b.phrase, ' ') AS said FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, said) AS rank FROM remaining)
SELECT lang, rank, said AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
