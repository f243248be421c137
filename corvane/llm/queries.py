"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, work_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of op4 and shards of op1, as their contracts fix them.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SHARDS = 8


def op1_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    packed = sharding.pack_into(read(spark, sf_dir, "documents"), SHARDS)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiling

    found = tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"), F.array_max(F.transform("tiles", lambda t: t["words"])).alias("longest_tile"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), full=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_rules

    return url_rules.judge(read(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), named AS (
  SELECT page_id, host, path, (
    SELECT arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) FROM rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM named
"""


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_count

    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ogg_media

    return ogg_media.roundtrip(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    path = work_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex),
b AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest, last
  FROM p JOIN g USING (hex)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM b
"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack_texts(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), full=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    c, docs = F.col, read(spark, sf_dir, "documents")
    hit = F.crc32(c("doc_id").cast("string")) % 7 == 0
    fields = [c("doc_id"), c("source"), c("lang"), c("n_chars"), c("text")]
    tampered = [*fields[:3], F.when(hit, c("n_chars") + 1).otherwise(c("n_chars")), c("text")]
    found = merkle.manifest(docs, fields, tampered)
    folded = found.withColumn("folded_root", merkle.fold(c("tampered"), c("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(c("proof")), 256).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))


#: crc32 of an id's decimal form, before the last inversion, bit by bit.
CRC_SQL = """crc AS (SELECT {id}, CAST(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen({id}::VARCHAR)), lambda b:
    CASE WHEN b % 8 = 0 THEN ascii(substr({id}::VARCHAR, CAST(b // 8 + 1 AS INT), 1)) ELSE 0 END::BIGINT)), lambda x, y:
    CASE WHEN xor(x, y) & 1 = 1 THEN xor(xor(x, y) >> 1, 3988292384::BIGINT) ELSE xor(x, y) >> 1 END) AS BIGINT) AS c FROM (SELECT DISTINCT {id} FROM {table})
)"""

OP12_SQL = """
WITH RECURSIVE CRC,
base AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(c, 4294967295::BIGINT) % 7 = 0, false) AS hit FROM documents LEFT JOIN crc USING (doc_id)
), e AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS mid, coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') AS moved, coalesce(strlen(text) || ':' || text, '-') AS tail FROM base
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || mid || tail) AS leaf, sha256(head || moved || tail) AS other FROM e
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), low(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY idx) FROM ranked GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM low WHERE len(nodes) > 1
), subs AS (SELECT tree, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS g FROM low WHERE len(nodes) = 1),
high(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY g) FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM high WHERE len(nodes) > 1
), top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
steps AS (
  SELECT r.tree, r.idx, l.level AS step, (r.idx >> l.level) & 1 AS side, l.nodes[CAST(xor(r.idx >> l.level, 1) + 1 AS INT)] AS sib FROM ranked r JOIN low l USING (tree) WHERE len(l.nodes) > 1
  UNION ALL
  SELECT r.tree, r.idx, s.height + h.level, (s.g >> h.level) & 1, h.nodes[CAST(xor(s.g >> h.level, 1) + 1 AS INT)] FROM ranked r JOIN subs s USING (tree) JOIN high h ON len(h.nodes) > 1
), proof AS (
  SELECT tree, idx, list({'side': side, 'sib': sib} ORDER BY step) AS p FROM steps GROUP BY tree, idx
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: coalesce(x.sib, '')), ''), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT r.*, s.subroot, top.root, p, list_reduce(list_prepend({'side': 0::BIGINT, 'sib': other}, coalesce(p, [])), lambda x, y: {'side': 0::BIGINT, 'sib':
    sha256(CASE WHEN y.side = 1 THEN y.sib || x.sib ELSE x.sib || coalesce(y.sib, '') END)}).sib AS folded
  FROM ranked r JOIN subs s USING (tree) CROSS JOIN top LEFT JOIN proof USING (tree, idx))
""".replace("CRC", CRC_SQL.format(id="doc_id", table="documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    convs, rows = prefix_trie.rebuilt(read(spark, sf_dir, "conversations"), 5, lambda c: F.crc32(c.cast("string")) % 9, 8)
    return prefix_trie.trie(convs, rows).drop("digest")


OP13_SQL = """
WITH CRC, t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:h], []), c.own[h + 1:]) AS seq FROM (SELECT c.*, xor(crc.c, 4294967295::BIGINT) % 9 AS h FROM c JOIN crc USING (conv_id)) c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), s AS (
  SELECT conv_id, list_transform(seq, lambda x: strlen(x.role) || ':' || x.role || strlen(x.text) || ':' || x.text) AS parts, list_transform(seq, lambda x: strlen(x.text)) AS sizes FROM r
), p AS (
  SELECT conv_id, d, len(parts) AS n, sha256(array_to_string(parts[1:d], '')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(parts[1:d - 1], '')) END AS up, coalesce(sizes[d], 0) AS bytes FROM s, unnest(range(len(parts) + 1)) AS u(d)
), nodes AS (
  SELECT key, d AS depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256 FROM p GROUP BY key, d
), kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, n_children IS NULL AS leaf FROM nodes LEFT JOIN kids USING (key)),
sums AS (SELECT p.key, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * own.bytes)::BIGINT AS saved_tokens FROM own JOIN p ON p.conv_id = own.conv_id AND p.d <= own.depth GROUP BY p.key)
SELECT own.conv_id, own.depth, a.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN sums USING (key) LEFT JOIN own a ON a.key = own.up AND a.depth = own.depth - 1
""".replace("CRC", CRC_SQL.format(id="conv_id", table="conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bin_packing, op2_decontaminate, op3_bpe_roundtrip, op4_url_filter, op5_simhash_dedup, op6_license_scan, op7_importance_resampling, op8_token_counts, op9_ogg_media, op10_warc, op11_packing, op12_merkle, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op10_warc": OP10_SQL, "op12_merkle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
