"""Registered queries of the operators, each over its whole table, and their results as SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.plans.lineage import stored

from . import (
    chat_windows, cover_tree, decontamination, exact_dedup, mixing, phrases, posting_lists, quality, secret_scan, simhash,
    token_counts, toxicity, url_filter,
)
from .tables import table

VOCABULARY = "byte_bpe_50k.json"
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PROBE = "</s>[INST] ok [/INST]"


def tokenizer(name: str = VOCABULARY) -> token_counts.Tokenizer:
    import public_tokenizers

    return token_counts.Tokenizer(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(), token_counts.CountCache(spark))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds to four fifths, by five-word shingles."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all conversations and of one full of control strings, read back from the formatted output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat_windows.read_back(stored(chat_windows.chat_windows(turns.unionByName(probe), tokenizer())))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), model, RULES).drop("url")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.words("text").alias("size")))
    mix = mixing.mixed(sized, size=F.col("size"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of good quality by either view and both, and whether the document is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", "p_text", "p_page", "p_quality", (F.col("p_quality") >= quality.KEEP).alias("kept")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 256 - F.pmod(x * 256, F.lit(1.0)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))
    return cover_tree.hard_negatives(rows)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_chat_windows": op3_chat_windows,
    "op4_url_filter": op4_url_filter,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_phrase_collocations": op13_phrase_collocations,
}

_WORDS = r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+"


def _shingle_sql(key: str, source: str) -> str:
    return f"""
    SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle
    FROM (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM {source})"""


ORACLE = {
    "op2_decontamination": f"""
WITH item AS ({_shingle_sql("item_id", "benchmark")}),
sizes AS (SELECT id, count(*) AS n FROM item GROUP BY id),
doc AS ({_shingle_sql("doc_id", "documents")}),
hits AS (SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS n_shared FROM doc JOIN item USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared::DOUBLE / n AS containment
FROM hits JOIN sizes ON item_id = id WHERE n_shared >= 0.8 * n - 1e-9""",
    "op6_mix_sources": r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k
    FROM d GROUP BY source),
w AS (
    SELECT source, source_size, [5.0, 2.0, 1.0][k + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
steps AS (
    SELECT k, cap / weight AS ratio, ((SELECT sum(source_size) FROM w) - sum(cap) OVER before)
        / ((SELECT sum(weight) FROM w) - sum(weight) OVER before) AS level
    FROM (SELECT cap, weight, row_number() OVER (ORDER BY cap / weight, source) AS k FROM w
          UNION ALL SELECT 0, 0, 0)
    WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ordered AS (
    SELECT k, level, lead(ratio) OVER (ORDER BY k) AS next FROM steps),
goal AS (
    SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, k) FROM ordered WHERE level <= next)) AS target FROM w),
parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
running AS (
    SELECT doc_id, d.source, size, sum(size) OVER (PARTITION BY d.source ORDER BY o, size) AS upto FROM d)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2 <= target - whole * source_size
        THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running JOIN parts ON running.source IS NOT DISTINCT FROM parts.source""",
    "op8_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t,
    FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size,
    doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY d.t, doc_id) = 1 AS kept,
    sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""",
    "op11_hard_negatives": r"""
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op13_phrase_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents WHERE text IS NOT NULL),
grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (
    SELECT lang, m, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
    FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
scored AS (
    SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
held AS (
    SELECT lang, a AS longer, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS size) WHERE size < m AND i + size - 1 <= m),
absorbed AS (SELECT lang, phrase, max(longer) AS longer FROM held GROUP BY ALL),
kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN absorbed USING (lang, phrase)
    WHERE nth = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
}
