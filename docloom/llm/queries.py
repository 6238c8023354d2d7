"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fingerprint, linededup, packing, quality, setjoin, sharding, tokenfiles


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    """Sequences of 4096 tokens from all documents."""
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_hash_tree_sharding(spark, sf_dir):
    """40 shards in 5 regions of 2 racks; a 41st shard opens a sixth region."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), sharding.uniform_tree(40), sharding.uniform_tree(41))


def op3_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return setjoin.jaccard_components(_read(spark, sf_dir, "documents"), n=3, least=90, of=100)


def op4_perspective_rotation(spark, sf_dir):
    """Every conversation as each of its participants sees it, turn by turn."""
    return chat.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op5_adaptive_dimension_scan(spark, sf_dir):
    """The five nearest of every fiftieth vector, against all others."""
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_token_files(spark, sf_dir):
    """All documents' ids, written to patched frame-of-reference files and read back."""
    manifest = tokenfiles.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read_token_files(manifest)


def op7_piecewise_hashing(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    """All lines that an equal or near line precedes."""
    return linededup.duplicate_lines(_read(spark, sf_dir, "documents")).drop("row")


def op9_byte_level_bpe(spark, sf_dir):
    """Ids of all documents and what they decode to."""
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_classifier(spark, sf_dir):
    """Quality scores of all documents from the labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _read(spark, sf_dir, "labels")), threshold=0.3)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing,
            op2_hash_tree_sharding,
            op3_ngram_jaccard_join,
            op4_perspective_rotation,
            op5_adaptive_dimension_scan,
            op6_token_files,
            op7_piecewise_hashing,
            op8_line_dedup,
            op9_byte_level_bpe,
            op10_quality_classifier,
        )
    }


def _draw(node: str, weight: str) -> str:
    return f"ln((('0x' || substr(md5(key || '|' || {node}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weight}"


def _sharding_sql() -> str:
    """The tree as a table of shards; each level keeps the child of the largest draw."""

    def tree(n: int) -> str:
        return f"(SELECT s AS shard, s // 4 AS rack, s // 8 AS region FROM range({n}) t(s))"

    def dealt(n: int) -> str:
        return f"""
        SELECT key, arg_max(shard, {_draw("'shard ' || shard", "1.0")}) AS shard FROM (
            SELECT key, arg_max(rack, {_draw("'rack ' || rack", "w")}) AS rack FROM (
                SELECT key, arg_max(region, {_draw("'region ' || region", "w")}) AS region
                FROM keys, (SELECT region, count(*)::DOUBLE AS w FROM {tree(n)} GROUP BY region) GROUP BY key
            ) JOIN (SELECT region, rack, count(*)::DOUBLE AS w FROM {tree(n)} GROUP BY region, rack) USING (region) GROUP BY key
        ) JOIN {tree(n)} USING (rack) GROUP BY key"""

    return f"""
    WITH docs AS (
        SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents
    ), keys AS (SELECT DISTINCT key FROM docs), old AS ({dealt(40)}), new AS ({dealt(41)}),
    crc_table AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
        FROM range(256) r(i)
    ), facts AS (
        SELECT doc_id, key, strlen(text) + 16 AS size,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
            ('0x' || substr(md5(key || '|' || md5(text)), 1, 2))::INTEGER AS segment
        FROM docs, crc_table
    )
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, old.shard::INTEGER AS shard,
        row_number() OVER (PARTITION BY old.shard ORDER BY segment, doc_id, size, text_crc32) - 1 AS slot,
        new.shard::INTEGER AS grown_shard, segment
    FROM facts JOIN old USING (key) JOIN new USING (key)"""


_CHAT_SQL = r"""
WITH clean AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM clean WHERE speaker <> 'system'),
seen AS (
    SELECT c.*, v.perspective,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
            ELSE '<|im_start|>user name=' || replace(regexp_replace(speaker, '\s+', '_', 'g'), '<|im_', '<| im_') || chr(10) END AS header
    FROM clean c JOIN views v ON c.conv_id IS NOT DISTINCT FROM v.conv_id
), framed AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM seen),
placed AS (
    SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
    FROM framed
)
SELECT conv_id, perspective, turn, speaker, role, rendered, start_char, start_char + length(rendered) AS end_char, role = 'assistant' AS trained,
    CASE WHEN role = 'assistant' THEN start_char + length(header) END AS mask_start,
    CASE WHEN role = 'assistant' THEN start_char + length(rendered) - 1 END AS mask_end
FROM placed"""

_LINES_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (
    SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS said, string_split_regex(trim(line, ' ' || chr(9) || chr(13)), '[ \t\r]+') AS words
    FROM split WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), kinds AS (SELECT said, any_value(words) AS words, array_to_string(any_value(words), ' ') AS whole, len(any_value(words)) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM lines GROUP BY said),
rests AS (
    SELECT said, whole, n, first, i, array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ') AS rest
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kinds WHERE n >= 8)
), near AS (
    SELECT a.said, min(b.first) AS earlier FROM rests a JOIN rests b ON a.n = b.n AND a.i = b.i AND a.rest = b.rest AND b.first < a.first GROUP BY a.said
    UNION ALL
    SELECT a.said, min(k.first) FROM rests a JOIN kinds k ON a.rest = k.whole AND k.n = a.n - 1 AND k.n >= 8 AND k.first < a.first GROUP BY a.said
    UNION ALL
    SELECT k.said, min(a.first) FROM rests a JOIN kinds k ON a.rest = k.whole AND k.n = a.n - 1 AND k.n >= 8 AND a.first < k.first GROUP BY k.said
), earliest AS (SELECT said, min(earlier) AS earlier FROM near GROUP BY said),
judged AS (
    SELECT l.doc_id, l.line_no, l.doc_id IS NOT DISTINCT FROM k.first.d AND l.line_no = k.first.l AS is_first, k.first, e.earlier
    FROM lines l JOIN kinds k ON l.said = k.said LEFT JOIN earliest e ON e.said = k.said
)
SELECT doc_id, line_no, CASE WHEN is_first THEN earlier.d ELSE first.d END AS kept_doc_id,
    CASE WHEN is_first THEN earlier.l ELSE first.l END AS kept_line_no, is_first::INTEGER AS near
FROM judged WHERE NOT is_first OR earlier IS NOT NULL"""

_JOIN_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM docs
), tokens AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS token FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(k, 0) AS n_links
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON doc_id = r.x LEFT JOIN (SELECT x, count(*) AS k FROM pairs GROUP BY x) p ON doc_id = p.x"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hash_tree_sharding": _sharding_sql(),
        "op3_ngram_jaccard_join": _JOIN_SQL,
        "op4_perspective_rotation": _CHAT_SQL,
        "op8_line_dedup": _LINES_SQL,
    }
