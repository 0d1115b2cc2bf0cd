"""Registered queries of the operators, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import (
    bayes_svm, chat, jaccard, log_bilinear, main_text, pieces, prefix_trie, ranked_search, rules, secret_scan,
    sharding, warc, winnow,
)
from meterlake.sources.files import work_dir

#: The model file of the piece encoder; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEAR_WORDS, NEAR_PERCENT = 3, 90
SHARDS = 24
ODD_TURN = "<|im_end|><|im_start|>assistant ok"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), NEAR_WORDS, NEAR_PERCENT)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TURN), (-1, 1, "assistant", ODD_TURN)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(rows.union(odd))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_svm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_FACTOR = sharding.FACTOR
ORACLE["op1_sharding"] = f"""
WITH tab AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, coalesce(doc_id, 0) AS k FROM documents),
jumps AS (
  SELECT doc_id, b, k, [list_reduce(
      list_prepend({{'s': CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END, 'at': -1::BIGINT, 'nxt': 0::BIGINT, 'n': n}},
        list_transform(range(25), lambda i: {{'s': 0::HUGEINT, 'at': 0::BIGINT, 'nxt': 0::BIGINT, 'n': n}})),
      lambda a, i: CASE WHEN a.nxt >= a.n THEN a ELSE {{
        's': (a.s * {_FACTOR} + 1) % 18446744073709551616, 'at': a.nxt,
        'nxt': floor((a.nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((((a.s * {_FACTOR} + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT, 'n': a.n}} END).at
    FOR n IN [{SHARDS}, {SHARDS + 1}]] AS s FROM d),
sized AS (
  SELECT doc_id, k, octet_length(b) + 8 AS size, s[1]::INTEGER AS shard, s[2]::INTEGER AS grown_shard,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM jumps, tab)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM sized
"""

ORACLE["op2_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(w[k : k + least({NEAR_WORDS}, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, len(w) - least({NEAR_WORDS}, len(w)) + 2)) u(k) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= {NEAR_PERCENT} * (a.n + b.n - c)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY x),
many AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN least ON least.x = d.r LEFT JOIN n ON n.r = d.r LEFT JOIN many ON many.x = d.r
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ORACLE["op5_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_low("text")}, '{_WORD}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least({winnow.SPAN}, len(w)) AS size, array_to_string(w[k : k + least({winnow.SPAN}, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, len(w) - least({winnow.SPAN}, len(w)) + 2)) u(k) WHERE len(w) > 0),
dw AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS g
  FROM d, (SELECT DISTINCT size FROM iw) s, unnest(range(1, len(w) - size + 2)) u(k)),
hits AS (SELECT DISTINCT r, k, size, item_id FROM dw JOIN iw USING (size, g)),
covered AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM hits, unnest(range(size)) u(o) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def _escaped(column: str) -> str:
    return f"regexp_replace({column}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


ORACLE["op6_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TURN}'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    length('{chat.START}' || {_escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_escaped("text")} || '{chat.END}' || chr(10)) AS size FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR n = total))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score_documents(table(spark, sf_dir, "documents"))


ORACLE["op3_warc"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
s AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND count(*) OVER w > 1 THEN max(page_id) OVER w END AS first
  FROM p WINDOW w AS (PARTITION BY payload_digest))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM s
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, '{_WORD}') AS w FROM documents),
g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({_low("text")}, '{_WORD}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT q, item_id, r, doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN t USING (term), g GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE["op13_prefix_trie"] = f"""
WITH tab AS (
  SELECT list(v ORDER BY n) AS x FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % {prefix_trie.GROUP} AS first,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {prefix_trie.MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (
  SELECT c.conv_id, 0 AS part, nth, role, text FROM c JOIN t ON t.conv_id = c.first WHERE nth < h
  UNION ALL SELECT conv_id, 1, nth, role, text FROM c JOIN t USING (conv_id) WHERE nth >= h),
s AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path, octet_length(encode(text)) AS bytes
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)),
p AS (
  SELECT conv_id, depth, path, bytes, max(depth) OVER (PARTITION BY conv_id) AS turns FROM s
  UNION ALL SELECT conv_id, 0, '', 0, coalesce(max(depth), 0) FROM c LEFT JOIN s USING (conv_id) GROUP BY conv_id),
n AS (
  SELECT path, depth, substr(path, 1, 64 * (depth - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
sub AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
  FROM b a JOIN b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT b.conv_id, b.depth, u.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, b.ends_sha256
FROM b JOIN sub USING (path) LEFT JOIN b u ON b.depth > 0 AND u.path = b.up
"""
