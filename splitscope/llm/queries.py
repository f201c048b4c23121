"""The registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from splitscope.llm import bpe, decontaminate, language, masked_lm, ngram_join, quality
from splitscope.llm import exact_dedup as exact
from splitscope.llm import near_dedup as near
from splitscope.llm import periodic_runs, repeats, secret_scan, token_counts, vector_codes

#: Rank file of the tokenizer queries.
RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.benchmark_overlaps(documents(spark, sf_dir), benchmark)


def op2_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(documents(spark, sf_dir))


def op3_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scores(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact.exact_dedup(docs, exact.older_half(docs))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return token_counts.counts_through_edits(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(documents(spark, sf_dir), percent=80)


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """One row in ten, by the checksum of its id, repeats the words from ``a`` on with period ``p``; rows without id do not."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(documents(spark, sf_dir), exponent=4, least=6, rewrite=repeated_tail)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spaced_seeds": op1_spaced_seeds,
        "op2_run_length_repeats": op2_run_length_repeats,
        "op3_layered_secrets": op3_layered_secrets,
        "op4_masked_lm": op4_masked_lm,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_edit_aware_counts": op6_edit_aware_counts,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_kneser_ney": op8_kneser_ney,
        "op9_minhash_odd_sketch": op9_minhash_odd_sketch,
        "op10_language_id": op10_language_id,
        "op11_walsh_codes": op11_walsh_codes,
        "op12_multi_order_join": op12_multi_order_join,
        "op13_periodic_runs": op13_periodic_runs,
    }


def codes_sql(rounds: int = 6) -> str:
    """Assignment and averaging unrolled, one table expression a round."""
    near = """n{i} AS (
        SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT row, x.part, entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{i} c ON x.part = c.part AND x.pos = c.pos
            GROUP BY ALL) GROUP BY row, part)"""
    move = """s{i} AS (
        SELECT part, entry, pos, sum(x.v)::HUGEINT AS s, count(*) AS n FROM x JOIN n{i} USING (row, part) GROUP BY ALL),
    c{j} AS (
        SELECT part, entry, pos, CASE WHEN n IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v
        FROM c{i} LEFT JOIN s{i} USING (part, entry, pos))"""
    steps = ",\n    ".join(f"{near.format(i=i)},\n    {move.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
    WITH k AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
              AND len(embedding) > 0),
    u AS (SELECT row, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i, len(e) // 8 AS w FROM k),
    x AS MATERIALIZED (SELECT row, i // w AS part, i % w AS pos, floor(4096e0 * v::DOUBLE)::BIGINT AS v FROM u),
    c0 AS (SELECT part, row AS entry, pos, v FROM x WHERE row < 16),
    {steps},
    {near.format(i=rounds)},
    h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM c{rounds}),
    r AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY row)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
    FROM r JOIN k USING (row), h"""


#: Components of the documents that share enough five-word shingles.
GROUPS_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
               ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    r AS (SELECT doc_id, doc_id AS reached FROM documents
          UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_walsh_codes": codes_sql(),
        "op12_multi_order_join": GROUPS_SQL,
        "op1_spaced_seeds": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
                       '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'),
                       '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
            b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
                       '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'),
                       '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark),
            dw AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM d),
            bw AS (SELECT item_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM b),
            m AS (SELECT doc_id, item_id, n, dw.p - bw.p AS shift, bw.p AS p FROM dw JOIN bw USING (w)),
            c AS (SELECT doc_id, item_id, n, shift, count(*) AS c FROM m GROUP BY ALL
                  HAVING count(*) >= CASE WHEN n < 8 THEN n WHEN n < 13 THEN n - 1 ELSE 11 END),
            s AS (SELECT doc_id, item_id, n, shift, unnest(range(1, n - least(n, 13) + 2)) AS s FROM c),
            r AS (SELECT s.doc_id, s.item_id, s.n, s.shift, s.s, count(*) AS same FROM s JOIN m USING (doc_id, item_id, shift)
                  WHERE m.p >= s.s AND m.p < s.s + least(s.n, 13) GROUP BY ALL)
            SELECT doc_id, item_id, max(same)::INT AS n_same, any_value(least(n, 13))::INT AS n_window FROM r
            GROUP BY doc_id, item_id HAVING max(same) >= any_value(CASE WHEN n < 8 THEN n WHEN n < 13 THEN n - 1 ELSE 11 END)""",
        "op9_minhash_odd_sketch": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
            s AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
                       ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
                  GROUP BY ALL),
            e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
                  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
            r AS (SELECT doc_id, doc_id AS reached FROM documents
                  UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
            SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id,
                   r.doc_id = min(reached) AS kept
            FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
        "op5_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    }
