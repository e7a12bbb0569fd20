"""The registered queries of this subpackage, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.encoding import encode_tokens
from skein.llm.exact_dedup import exact_duplicates
from skein.llm.hard_negatives import hard_negatives
from skein.llm.html_wrappers import extract_main_text
from skein.llm.line_dedup import without_repeated_chunks
from skein.llm.one_bit_search import nearest_rows
from skein.llm.packing import best_fit, cut_lengths
from skein.llm.piece_codec import encode_pieces
from skein.llm.quality_rules import quality_rules
from skein.llm.simhash import near_duplicates
from skein.llm.substring_dedup import substring_duplicates
from skein.llm.token_alignment import alignment_counts
from skein.llm.token_counts import token_counts
from skein.llm.token_files import read_tokens, write_tokens
from skein.session import cut, scratch_path

SEQUENCE_TOKENS = 2048
BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_SIZE = 50_257
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file(PIECES))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="max")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeated_chunks(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(documents(spark, sf_dir), tokenizer_file(PIECES))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def packed_documents(docs: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of the encoded ``docs`` in their sequences, with the checksum of each piece's ids.

    Null and empty texts are a piece of one id, the end id; rows that repeat an id are packed each; an empty table gives no rows; other columns are ignored.
    """
    tokens = encode_tokens(docs, tokenizer_file(BYTE_BPE))
    tokens = tokens.withColumn("n", (F.octet_length("ids") / 4).cast("long"))
    pieces = tokens.select("doc_id", "ids", F.inline(cut_lengths("n", size)))
    checksum = F.crc32(F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    pieces = cut(pieces.select("doc_id", "piece", "start", "length", checksum.alias("ids_crc32")), "pieces")
    return best_fit(pieces, size)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, tokenizer_file(BYTE_BPE), BYTE_BPE_SIZE)
    return read_tokens(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_duplicates(documents(spark, sf_dir))
    kept = F.when(F.isnull("kept_text"), F.lower(F.hex("words_sha256"))).otherwise(F.sha2("kept_text", 256))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("text_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(documents(spark, sf_dir), tokenizer_file(BYTE_BPE), tokenizer_file(PIECES))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_simhash": op6_simhash,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_one_bit_search": op12_one_bit_search,
    "op13_token_alignment": op13_token_alignment,
}

# Vectors that take part, as lists of doubles.
_VECTORS = """
        e AS (
            SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        )"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
    """,
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
        windows AS (
            SELECT doc_id, word, i, n, CASE WHEN i + 50 <= n THEN md5(string_agg(word, ' ') OVER (
                PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h
            FROM w
        ),
        starts AS (SELECT doc_id, word, i, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS later FROM windows),
        marked AS (
            SELECT doc_id, word, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM starts
        ),
        kept AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op10_quality_rules": """
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM d
        ),
        places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+7], ' ')) AS n FROM places),
        covered AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM windows WHERE n > 1),
        repeats AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS r FROM covered GROUP BY doc_id),
        c AS (
            SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
                coalesce(r, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN repeats ON w.doc_id = repeats.doc_id
        ),
        f AS (
            SELECT *, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 30 * word_chars,
                100 * n_dup_lines > 50 * n_lines]) AS failed, unnest(range(4)) AS rule FROM c
        ),
        h AS (SELECT rule, source, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY ALL),
        m AS (SELECT rule, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n) AS docs FROM h GROUP BY rule),
        s AS (SELECT h.rule, sum(n * (k / n - mean) ^ 2) / any_value(docs) AS spread FROM h JOIN m ON h.rule = m.rule GROUP BY h.rule),
        p AS (
            SELECT m.rule, mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * hosts / docs, 1e-12) - 1, 1), 1e6) AS weight
            FROM m JOIN s ON m.rule = s.rule
        ),
        v AS (SELECT source, max((k + mean * weight) / (n + weight)) > 0.8 AS rejected FROM h JOIN p ON h.rule = p.rule GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT rejected AS kept
        FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source
    """,
    "op11_hard_negatives": f"""
        WITH {_VECTORS.strip()}, c AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x) for x in v] AS v
            FROM e WHERE label IS NOT NULL
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM c AS a JOIN c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
    "op12_one_bit_search": f"""
        WITH {_VECTORS.strip()}, c AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS length FROM e WHERE list_inner_product(v, v) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.length * c.length) AS score
            FROM c AS q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        QUALIFY rank <= 5
    """,
}
