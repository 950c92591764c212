"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards."""
    from plexmat.llm import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    from plexmat.llm import line_rules

    return line_rules.document_rules(_table(spark, sf_dir, "documents"))


def op5_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    from plexmat.llm import rule_ensemble

    return rule_ensemble.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to grammar files and read back."""
    from public_tokenizers import path

    from plexmat.llm import grammar

    return grammar.round_trip(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), end_id=1)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    from public_tokenizers import path

    from plexmat.llm import bpe

    return bpe.digest_documents(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op6_license_minhash_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in every document."""
    from plexmat.llm import license_scan

    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    from plexmat.llm import toxicity

    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, held against its edited text and the next document."""
    from plexmat.llm import iblt

    return iblt.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    from plexmat.llm import chosen_path

    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    from plexmat.llm import mixing

    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op11_quantised_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among all embeddings."""
    from plexmat.llm import hard_negatives

    return hard_negatives.mine_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_duckdb_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-the-middle form and of the text restored from it."""
    from plexmat.llm import fim

    return fim.digest_documents(_table(spark, sf_dir, "documents"))


def op13_offset_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, the spans and the decoded text of every document."""
    from public_tokenizers import path

    from plexmat.llm import pieces

    return pieces.digest_documents(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rendezvous_sharding": op1_rendezvous_sharding,
    "op2_repair_token_files": op2_repair_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_frequency_rules": op4_line_frequency_rules,
    "op5_rule_ensemble_quality": op5_rule_ensemble_quality,
    "op6_license_minhash_scan": op6_license_minhash_scan,
    "op7_subword_toxicity": op7_subword_toxicity,
    "op8_iblt_fingerprints": op8_iblt_fingerprints,
    "op9_chosen_path_join": op9_chosen_path_join,
    "op10_block_mixture": op10_block_mixture,
    "op11_quantised_hard_negatives": op11_quantised_hard_negatives,
    "op12_duckdb_fill_in_middle": op12_duckdb_fill_in_middle,
    "op13_offset_sentencepiece": op13_offset_sentencepiece,
}

#: crc32 has no built-in in DuckDB: the bytes of a text are folded over the 256 remainders of its polynomial.
_OP1_SQL = """
WITH RECURSIVE steps AS (
    SELECT i AS byte, i AS c, 0 AS n FROM range(256) r(i)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
),
remainders AS (SELECT list(c ORDER BY byte) AS tab FROM steps WHERE n = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
summed AS (
    SELECT doc_id, strlen(text) + 16 AS size,
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM docs, remainders
),
drawn AS (
    SELECT doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) AS score
    FROM (SELECT DISTINCT doc_id FROM documents), range(41) r(s)
),
placed AS (
    SELECT doc_id, arg_min(s, score) FILTER (s < 40) AS shard, arg_min(s, score) AS grown_shard FROM drawn GROUP BY doc_id
)
SELECT d.doc_id, d.size::BIGINT AS size, d.text_crc32::BIGINT AS text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
    (row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 3), d.doc_id, d.text_crc32, d.size) - 1)::BIGINT AS slot,
    p.grown_shard::INTEGER AS grown_shard
FROM summed d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
"""

_SPACE = r"[\x20\x09-\x0D]"
#: The line rule on normalised lines themselves, which the query knows by 64-bit hashes.
_OP4_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM cut),
grams AS (SELECT r, list(p) AS held FROM places GROUP BY r, words[p], words[p + 1], words[p + 2] HAVING count(*) > 1),
repeats AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([p, p + 1, p + 2]) AS p FROM (SELECT r, unnest(held) AS p FROM grams)) GROUP BY r),
counts AS (
    SELECT d.r, d.doc_id, d.source, d.text, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM docs d JOIN cut USING (r) LEFT JOIN repeats USING (r)
),
lines AS (SELECT r, trim(lower(regexp_replace(x, '{_SPACE}+', ' ', 'g'))) AS line, len(list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda w: w <> '')) AS n FROM (SELECT r, unnest(lines) AS x FROM cut)),
hosts AS (SELECT source, greatest(10, 0.001 * count(*)) AS most FROM documents GROUP BY source),
over_limit AS (
    SELECT c.source, line FROM (SELECT source, line, count(DISTINCT (coalesce('=' || doc_id, ''), text)) AS n FROM lines JOIN docs USING (r) GROUP BY 1, 2) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > most
),
lost AS (SELECT r, sum(n) AS removed FROM lines JOIN docs USING (r) JOIN over_limit o ON o.line = lines.line AND o.source IS NOT DISTINCT FROM docs.source GROUP BY r),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(removed, 0)::BIGINT AS removed_words FROM counts LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept, removed_words
FROM judged
"""

#: Every product of an anchor and a row; doubles hold these whole numbers exactly.
_OP11_SQL = """
WITH items AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM items a JOIN items b ON a.r <> b.r WHERE a.vec_id % 50 = 0
),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
pairs AS (
    SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) AS rank
    FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 3
"""

#: The parts are cut by their lengths here, and a restored text must be the text.
_OP12_SQL = rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda u: length(u)) AS sizes,
        list_transform(range(4), lambda k: ('0x' || substr(sha256('42:' || doc_id), (8 * k + 1)::INTEGER, 8))::BIGINT) AS h
    FROM documents
),
drawn AS (
    SELECT doc_id, text, len(sizes) AS n, coalesce(list_sum(sizes[:least(h[1] % (len(sizes) + 1), h[2] % (len(sizes) + 1))]), 0)::BIGINT AS first,
        coalesce(list_sum(sizes[:greatest(h[1] % (len(sizes) + 1), h[2] % (len(sizes) + 1))]), 0)::BIGINT AS last,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN first END AS prefix_chars, CASE WHEN form <> 'plain' THEN last - first END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, first) || '<S>' || substr(text, last + 1) || '<M>' || substr(text, first + 1, last - first)
        ELSE '<S>' || substr(text, last + 1) || '<P>' || substr(text, 1, first) || '<M>' || substr(text, first + 1, last - first) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM drawn
"""

ORACLES: dict[str, str] = {
    "op1_rendezvous_sharding": _OP1_SQL,
    "op4_line_frequency_rules": _OP4_SQL,
    "op11_quantised_hard_negatives": _OP11_SQL,
    "op12_duckdb_fill_in_middle": _OP12_SQL,
}
