"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .chat import op8_chat
from .decontaminate import op6_decontaminate
from .line_rules import MAX_SHARE, MIN_DOCS, MIN_TEXTS, op10_line_rules
from .lm_score import op7_lm_score
from .minhash import op12_minhash
from .quality_model import op9_quality_model
from .ranked_search import op13_ranked_search
from .resample import op11_resample
from .secret_scan import op4_secrets
from .sharding import op2_sharding
from .simhash import op1_simhash
from .url_filter import HOST_RULES, PATTERN_RULES, op5_urls


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_urls": op5_urls,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_chat": op8_chat,
    "op9_quality_model": op9_quality_model,
    "op10_line_rules": op10_line_rules,
    "op11_resample": op11_resample,
    "op12_minhash": op12_minhash,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

_CONVERSATIONS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), rendered AS (  -- characters of the markers, and of the escapes where a text would not read back as it is
    SELECT *, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE '<</>>' END AS closing,
        CASE role WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 3 + 4 ELSE 4 + 5 + length(role) END AS markers,
        len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = '\' OR regexp_matches(substr(text, i, 8), '^[\[<>](/?INST\]|/?s>|<|>)'))) AS escapes,
        CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE len(list_filter(range(1, length(role) + 1),
            lambda i: substr(role, i, 1) = '\' OR regexp_matches(substr(role, i, 8), '^[\[<>](/?INST\]|/?s>|<|>)'))) END AS role_escapes
    FROM turns
), read AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(text) + markers + role_escapes
            + CASE WHEN strpos(text || closing, closing) <= length(text) OR strpos(text, '\') > 0 THEN escapes ELSE 0 END) AS formatted_chars
    FROM rendered GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM read
"""



def _urls_sql() -> str:
    by_length = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by_length)
    patterns = " ".join(f"WHEN regexp_matches(lower(url), '{r.pattern}') THEN '{r.verdict}'" for r in PATTERN_RULES)
    return f"""SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {patterns} ELSE 'allow' END AS verdict
        FROM (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))"""


_LINE_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own FROM d),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
texts AS (SELECT DISTINCT doc_id, host, text, own FROM w),
lines AS (SELECT DISTINCT doc_id, host, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, pos
    FROM (SELECT doc_id, host, text, unnest(own) AS l, unnest(range(len(own))) AS pos FROM texts)),
frequent AS (SELECT host, line FROM lines JOIN (SELECT host, count(*) AS docs FROM texts GROUP BY host) USING (host)
    GROUP BY host, line, docs HAVING count(DISTINCT (doc_id, text)) > {MIN_DOCS} AND count(DISTINCT (doc_id, text)) > {MAX_SHARE} * docs AND count(DISTINCT text) >= {MIN_TEXTS}),
lost AS (SELECT host, text, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM (SELECT DISTINCT host, text, line, pos FROM lines) JOIN frequent USING (host, line) GROUP BY host, text),
measured AS (SELECT doc_id, host, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(own) - len(list_distinct(own)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * coalesce(l.n, 0) <= n_words AS kept
FROM measured LEFT JOIN lost l USING (host, text)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RESAMPLE = rf"""
WITH words AS (
    SELECT 0 AS kind, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL SELECT 1, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), crc AS (  -- the table of CRC-32 by its rule
    SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT) ORDER BY i) AS rows FROM range(256) r(i)
), hashed AS (
    SELECT word, xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::UBIGINT),
        lambda c, b: xor(c >> 8, rows[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT)) % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc
), features AS (SELECT kind, doc_id, bucket FROM words JOIN hashed USING (word)),
totals AS (SELECT count(*) FILTER (WHERE kind = 0)::DOUBLE AS s_all, count(*) FILTER (WHERE kind = 1)::DOUBLE AS t_all FROM features),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM totals,
    (SELECT bucket, count(*) FILTER (WHERE kind = 0)::DOUBLE AS s, count(*) FILTER (WHERE kind = 1)::DOUBLE AS t FROM features GROUP BY bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_MINHASH = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM words
), sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
members AS (SELECT rep, n, unnest(s) AS g FROM sets),
links AS (SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
    SELECT rep AS node, rep AS other FROM sets
    UNION SELECT r.node, l.b FROM reached r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.other
), roots AS (SELECT node AS rep, min(other) AS root FROM reached GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM shingled LEFT JOIN sets USING (s) LEFT JOIN roots USING (rep)
"""

_RANKED_SEARCH = rf"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT term, doc_id, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY term, doc_id),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
impacts AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS impact
    FROM postings JOIN weights USING (term) JOIN lengths USING (doc_id), corpus),
scored AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

SQL: dict[str, str] = {
    "op5_urls": _urls_sql(),
    "op8_chat": _CONVERSATIONS,
    "op10_line_rules": _LINE_RULES,
    "op11_resample": _RESAMPLE,
    "op12_minhash": _MINHASH,
    "op13_ranked_search": _RANKED_SEARCH,
}
