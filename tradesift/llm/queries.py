"""The opN_ queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradesift.llm import bpe, chat_format, exact_dedup, importance, periodic_runs, pii, quality_rules, repeat_removal, secret_scan, simhash_dedup, source_mixing, token_shards, url_filter
from tradesift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


QUERIES["op4_quality_rules"] = op4_quality_rules
_stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
ORACLES["op4_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM l),
p AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM g),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
c AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_stop})))::BIGINT AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\pL')))::BIGINT AS n_letter_words,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines
      FROM g LEFT JOIN cover USING (doc_id)),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  list_filter([
    CASE WHEN NOT (coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2 AND 15) THEN 'mean word length' END,
    CASE WHEN coalesce(n_symbols / nullif(n_words, 0), 0) > 0.15 THEN 'symbols per word' END,
    CASE WHEN coalesce(n_stop_words / nullif(n_words, 0), 0) < 0.02 AND n_words >= 30 THEN 'stop words' END,
    CASE WHEN coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.5 THEN 'duplicate lines' END,
    CASE WHEN coalesce(n_bullet_lines / nullif(n_lines, 0), 0) > 0.9 THEN 'bullet lines' END,
    CASE WHEN coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) > 0.3 THEN 'ellipsis lines' END,
    CASE WHEN coalesce(n_letter_words / nullif(n_words, 0), 0) < 0.6 THEN 'words with a letter' END],
    lambda x: x IS NOT NULL) AS failed_rules FROM c)
SELECT *, NOT base_failed AND len(failed_rules) = 0 AS kept FROM j
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES["op3_exact_dedup"] = op3_exact_dedup
ORACLES["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES["op2_source_mixing"] = op2_source_mixing
_weights = ", ".join(map(str, source_mixing.WEIGHTS))
_up, _down = source_mixing.SHARE
#: Targets by their definition: sources over the level are capped one round after another, until none is.
ORACLES["op2_source_mixing"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{_weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(source_mixing.WEIGHTS)} + 1)::INTEGER]::BIGINT AS weight FROM d GROUP BY source),
rounds AS (
  SELECT source, source_size, weight, false AS capped, 0 AS n, NULL::DOUBLE AS level FROM s
  UNION ALL
  (WITH r AS (SELECT *, (sum(source_size) OVER () * {_up} - {_down} * coalesce(sum(source_size * {source_mixing.MAX_REPEAT}) FILTER (capped) OVER (), 0))::DOUBLE
                      / (coalesce(sum(weight) FILTER (NOT capped) OVER (), 0) * {_down})::DOUBLE AS now FROM rounds)
   SELECT source, source_size, weight, capped OR now >= (source_size * {source_mixing.MAX_REPEAT})::DOUBLE / weight, n + 1, now FROM r
   WHERE n <= (SELECT count(*) FROM s) AND now IS DISTINCT FROM level)),
t AS (SELECT source, source_size, CASE WHEN capped THEN (source_size * {source_mixing.MAX_REPEAT})::DOUBLE ELSE weight * level END AS target FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
x AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)::INTEGER) ELSE 0 END AS class,
             ('0x' || left(md5('{source_mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS x FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, x, doc_id, size) AS k FROM x),
j AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || left(md5('{source_mixing.SEED}:' || (p.source IS NULL)::INTEGER || ':' || coalesce(p.source, '')), 13))::BIGINT / {1 << 52}::DOUBLE AS u
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


QUERIES["op5_simhash_dedup"] = op5_simhash_dedup


#: The tokenizer of the contract; a parameter of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


QUERIES["op6_secret_scan"] = op6_secret_scan


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


QUERIES["op9_url_filter"] = op9_url_filter
_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
ORACLES["op9_url_filter"] = f"""
WITH rules(verdict, h, p) AS (VALUES {_rules}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
m AS (SELECT u.*, max(struct_pack(n := length(h || p), k := length(h), rule := h || p, verdict := rules.verdict)) AS best
      FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


QUERIES["op10_pii"] = op10_pii


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


QUERIES["op7_chat_format"] = op7_chat_format


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES["op8_token_shards"] = op8_token_shards


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.planted))


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES["op12_importance"] = op12_importance
#: SQL has no CRC-32: it is folded over the bytes of each different word by a table that a recursive query makes.
ORACLES["op12_importance"] = f"""
WITH RECURSIVE step(v, c, k) AS (
  SELECT v, v, 0 FROM range(256) AS r(v)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {importance.POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
t AS (SELECT list(c ORDER BY v) AS crc FROM step WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
v AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket FROM words, t),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (word) GROUP BY 1),
u AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {importance.BUCKETS})::DOUBLE
                                / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM u), 0) + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN u USING (bucket)),
e AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
f AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('{importance.SEED}:' || d.doc_id), 8))::BIGINT AS h FROM d LEFT JOIN e USING (doc_id)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM x WHERE n_features >= {importance.LEAST_WORDS})
SELECT x.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= eligible * {importance.SHARE[0]} // {importance.SHARE[1]} THEN place END::BIGINT AS rank
FROM x LEFT JOIN r USING (doc_id)
"""


def op13_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.digest(repeat_removal.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES["op13_repeat_removal"] = op13_repeat_removal
#: Every string of the width, by hand: all but the first of equal ones cover bytes.
ORACLES["op13_repeat_removal"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * repeat_removal.WIDTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {repeat_removal.WIDTH} + 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
steps AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {repeat_removal.WIDTH}, true) AS apart FROM again),
runs AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {repeat_removal.WIDTH} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS t, max(b) AS last, sum(b - a) AS n, count(*) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(t || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
