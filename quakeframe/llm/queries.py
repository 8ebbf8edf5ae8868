"""One query per operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, exact_dedup, html_extract, langid, lexical, line_dedup, media, mixing, simhash_dedup, token_store, toxicity, url_filter
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.stored_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_simhash_near_dedup, op3_url_filters, op4_line_dedup, op5_exact_dedup, op6_toxicity, op7_mixing,
        op8_media_columns, op9_language_id, op10_bpe, op11_token_store, op12_ranked_search, op13_conversation_trie,
    )
}

_OP3 = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut
), rules(rule, rhost, rpath, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
)
SELECT page_id, host, path,
       (SELECT max_by(rule, length(rule)) FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule,
       coalesce(
         (SELECT max_by(r.verdict, length(rule)) FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
         CASE WHEN regexp_matches(host || path, '(^|[./:_-])(casino|poker|porn|xxx|viagra|warez|torrent)([./:_-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p
"""

_OP5 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP7_LEVEL = """
{name}_n AS ({nodes}),
{name}_o AS (
  SELECT *, greatest(parent_budget - coalesce(sum(capacity) OVER (PARTITION BY {part} ORDER BY capacity, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
            / count(*) OVER (PARTITION BY {part} ORDER BY capacity, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {name}_n
),
{name} AS (
  SELECT *, least(capacity, coalesce(max(CASE WHEN level < capacity THEN level END) OVER (PARTITION BY {part}), capacity)) AS budget FROM {name}_o
)"""


def _op7_sql(share: float = 0.8, epochs: int = 2, seed: int = 17) -> str:
    level = _OP7_LEVEL.format
    first = f"SELECT domain, sum(tokens) * {epochs}.0::DOUBLE AS capacity, any_value(t.total) * {share}::DOUBLE AS parent_budget FROM leaves, (SELECT sum(tokens) AS total FROM leaves) t GROUP BY domain HAVING sum(tokens) > 0"
    second = f"SELECT l.domain, lang, sum(tokens) * {epochs}.0::DOUBLE AS capacity, any_value(d.budget) AS parent_budget FROM leaves l JOIN dom d ON l.domain IS NOT DISTINCT FROM d.domain GROUP BY l.domain, lang HAVING sum(tokens) > 0"
    third = f"SELECT l.domain, l.lang, source, tokens, tokens * {epochs}.0::DOUBLE AS capacity, d.budget AS parent_budget FROM leaves l JOIN lng d ON l.domain IS NOT DISTINCT FROM d.domain AND l.lang IS NOT DISTINCT FROM d.lang WHERE tokens > 0"
    return rf"""
WITH docs AS (
  SELECT doc_id, 'domain' || (CASE WHEN number = '' THEN 0 ELSE number::BIGINT % 4 END)::VARCHAR AS domain, lang, source, n_tokens
  FROM (SELECT *, regexp_extract(coalesce(source, ''), '(\d+)', 1) AS number, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
{level(name="dom", nodes=first, part="1", child="domain")},
{level(name="lng", nodes=second, part="domain", child="lang")},
{level(name="src", nodes=third, part="domain, lang", child="source")},
placed AS (
  SELECT d.*, e.epoch, s.budget, (e.epoch - 1) * s.tokens + coalesce(sum(n_tokens) OVER (
           PARTITION BY d.domain, d.lang, d.source, e.epoch ORDER BY md5('{seed}:' || e.epoch || ':' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN src s ON d.domain IS NOT DISTINCT FROM s.domain AND d.lang IS NOT DISTINCT FROM s.lang AND d.source IS NOT DISTINCT FROM s.source, range(1, {epochs + 1}) e(epoch)
)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens::BIGINT AS n_tokens, round(budget, 3) AS budget FROM placed WHERE before < budget
"""


_OP12 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
stats AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), stats GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

_OP13 = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id
), h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                            lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 4 AS h
  FROM own
), conv AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM conv),
prefixes AS (SELECT conv_id, depth, md5(turns[1:depth]::JSON::VARCHAR) AS node, md5(turns[1:depth - 1]::JSON::VARCHAR) AS up, turns[depth].t AS last, depth = len(turns) AS ends FROM steps),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up,
         (count(*) - 1) * (CASE WHEN depth = 0 THEN 0 ELSE any_value(len(regexp_extract_all(last, '[^ 	-
]+'))) END) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node),
below AS (
  SELECT p.depth, p.node, sum(f.own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves
  FROM full_nodes f JOIN prefixes p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.depth = f.depth AND b.node = f.node LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.node = f.up
"""

ORACLES = {"op12_ranked_search": _OP12, "op13_conversation_trie": _OP13, "op3_url_filters": _OP3, "op5_exact_dedup": _OP5, "op7_mixing": _op7_sql()}
