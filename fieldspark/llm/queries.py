"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import op01_paragraphs, op02_bbit_minhash, op03_divergence, op04_sparse_suffixes, op05_fourier_quality
from fieldspark.llm import op06_typed_parts, op07_suffix_tree, op08_token_counts, op09_grouping_genetic
from fieldspark.llm import op10_spaced_seeds as op10
from fieldspark.llm import op11_equal_average as op11
from fieldspark.llm import op12_two_tier_bpe as op12
from fieldspark.llm import op13_phrases as op13
from fieldspark.llm.store import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a tokenizer file lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents")).drop("row")


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_divergence.quality(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op04_sparse_suffixes.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", F.col("span.start").alias("first_word"), (F.col("span.end") - 1).alias("last_word"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_fourier_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations").select(columns).unionByName(op06_typed_parts.tricky(spark))
    return op06_typed_parts.digests(op06_typed_parts.format_turns(turns.withColumn("parts", op06_typed_parts.text_part("text"))))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_suffix_tree.scores(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_grouping_genetic.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("first_word")


def op11_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.compress(table(spark, sf_dir, "embeddings"))


def op12_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return op12.digests(op12.decode(op12.encode(table(spark, sf_dir, "documents"), path), path))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.phrases(table(spark, sf_dir, "documents"))


_ALL = [
    op1_paragraphs, op2_bbit_minhash, op3_divergence, op4_sparse_suffixes, op5_fourier_quality, op6_typed_parts, op7_suffix_tree,
    op8_token_counts, op9_grouping_genetic, op10_spaced_seeds, op11_equal_average, op12_two_tier_bpe, op13_phrases,
]
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def tokens(source: str, key: str) -> str:
    """SQL: the lower-cased words of a table's texts."""
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM {source}"


def near_sql(size: int, source: str = "documents") -> str:
    """SQL: CTEs up to ``near``, with a document's component."""
    return f"""
near_tokens AS ({tokens(source, "doc_id")}),
near_sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+{size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})]) END AS s FROM near_tokens),
near_classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM near_sets WHERE len(s) > 0 GROUP BY list_sort(s)),
near_items AS (SELECT id, n, unnest(s) AS g FROM near_classes),
near_common AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM near_items a JOIN near_items b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id),
near_links AS (SELECT a, b FROM near_common WHERE 100 * shared >= 80 * (na + nb - shared)),
near_ways AS (SELECT a, b FROM near_links UNION SELECT b, a FROM near_links),
near_reach AS (SELECT id AS a, id AS b FROM near_classes UNION SELECT r.a, e.b FROM near_reach r JOIN near_ways e ON e.a = r.b),
near_component AS (SELECT a, min(b) AS c FROM near_reach GROUP BY a),
near AS (SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(k.c, t.doc_id) AS component_id, coalesce(k.c, t.doc_id) = t.doc_id AS kept
  FROM near_sets t LEFT JOIN near_classes ON near_classes.s = list_sort(t.s) LEFT JOIN near_component k ON k.a = near_classes.id)"""


def repeats_sql(source: str = "documents") -> str:
    """SQL: CTEs up to ``repeated``, the maximal repeated passages."""
    return f"""
rep_tokens AS ({tokens(source, "doc_id")}),
rep_stretches AS (SELECT doc_id, unnest([{{'i': i - 1, 's': array_to_string(w[i:i+49], ' ')}} FOR i IN range(1, len(w) - 48)]) AS x FROM rep_tokens WHERE len(w) >= 50),
rep_ranked AS (SELECT doc_id, x.i AS i, row_number() OVER (PARTITION BY x.s ORDER BY doc_id, x.i) AS k FROM rep_stretches),
rep_later AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM rep_ranked WHERE k > 1),
rep_groups AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM rep_later),
repeated AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) + 49 AS INTEGER) AS last_word FROM rep_groups GROUP BY doc_id, g)"""


def overlap_sql(source: str = "documents") -> str:
    """SQL: CTEs up to ``overlapping``: word against word, every place of a document with every place of an item that has the same word."""
    return f"""
ov_docs AS (SELECT doc_id, len(w) AS n, w FROM ({tokens(source, "doc_id")})),
ov_items AS (SELECT item_id, len(w) AS n, w FROM ({tokens("benchmark", "item_id")}) WHERE len(w) >= 8),
ov_dw AS (SELECT doc_id, n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM ov_docs),
ov_iw AS (SELECT item_id, n, least(n, 16) AS span, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM ov_items),
ov_equal AS (SELECT doc_id, item_id, p - q AS diagonal, q, i.n AS ni, d.n AS nd, span FROM ov_dw d JOIN ov_iw i USING (t)),
ov_sums AS (
  SELECT doc_id, item_id, diagonal, span, least(q, least(ni, nd - diagonal) - span) AS a, greatest(0, -diagonal) AS lo,
    CASE WHEN span = 16 THEN count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING)
      ELSE count(*) OVER (PARTITION BY doc_id, item_id, diagonal) END AS c
  FROM ov_equal),
overlapping AS (SELECT doc_id, item_id, max(c) AS matches FROM ov_sums WHERE a >= lo AND c >= span - span * 3 // 16 GROUP BY doc_id, item_id)"""


SQL = {
    "op2_bbit_minhash": f"WITH RECURSIVE {near_sql(4)} SELECT doc_id, n_shingles, component_id, kept FROM near",
    "op4_sparse_suffixes": f"WITH {repeats_sql()} SELECT doc_id, first_word, last_word FROM repeated",
    "op10_spaced_seeds": f"WITH {overlap_sql()} SELECT doc_id, item_id, matches FROM overlapping",
    "op11_equal_average": op11.sql(),
    "op13_phrases": op13.sql(),
}
