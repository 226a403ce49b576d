"""The registered queries of this package: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import table

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.projection_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.simhash_trees import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), with_ids=False)


def op4_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.hilbert_search import search

    return search(table(spark, sf_dir, "embeddings"))


def op5_style_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.style_trees import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.maxent_lm import score

    return score(table(spark, sf_dir, "documents"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.quality_crf import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.sentence_pieces import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer(PIECE_BPE))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents")).drop("doc_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.token_store import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE)), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Vectors that take part, as doubles.
GOOD = "good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express whole: those on vectors, by brute force. The others need hashes or tokenizers that it lacks."""
    return {
        "op1_projection_forest": f"""
            WITH RECURSIVE {GOOD},
            links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
            reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
            comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
            SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.a = vec_id""",
        "op4_hilbert_search": f"""
            WITH {GOOD},
            d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
            SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 10""",
        "op11_phrases": r"""
            WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
            spans AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, range(1, 5) AS t(k) WHERE len(w) >= k),
            f AS (SELECT lang, phrase, k, count(*) AS f FROM spans GROUP BY ALL),
            total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
            found AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
            inner_parts AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM found WHERE k > 2),
            longer AS (SELECT lang, phrase, max(a) AS top FROM (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM inner_parts) GROUP BY lang, phrase),
            cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS c, w, k FROM found),
            scored AS (
                SELECT cuts.lang, cuts.phrase, a, h.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + r.f) AS BIGINT) AS score, c FROM cuts
                JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1 : c], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[c + 1 : cuts.k], ' ')),
            least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
            kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE top IS NULL OR 100 * top < 80 * a)
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept JOIN total USING (lang)
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    }
