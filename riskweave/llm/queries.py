"""One query for each operator, over its whole tables, and the SQL of those that SQL can express."""

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bpe_automaton,
    byte_bpe,
    chat,
    decontaminate,
    filter_audit,
    forest,
    jaccard,
    language_model,
    records,
    secrets,
    toxicity,
    url_rules,
    whitening,
)
from riskweave.llm.common import new_folder, table
from riskweave.operators.runtime import stored

Query = Callable[[SparkSession, str], DataFrame]

END_ID = 2
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SAYING = "</s>[INST] ok [/INST]"
EXTRA_TURNS = [(-7, 0, "user", SAYING), (-7, 1, "assistant", SAYING)]


def op1_token_records(spark, folder):
    """Documents as binary records, read back through their index."""
    place = new_folder(spark, "records")
    path = public_tokenizers.path("word_bpe_49k.json")
    records.write_records(table(spark, folder, "documents"), path, place, end_id=END_ID)
    return records.map_records(
        records.read_index(spark, place),
        place,
        lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
        "n_tokens long, ids_crc32 long",
    )


def op2_byte_bpe(spark, folder):
    """Every text encoded and decoded again, as digests."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, folder, "documents"), *vocabulary)
    return byte_bpe.decode(encoded, *vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_url_rules(spark, folder):
    """Verdict of the longest rule for every page."""
    return url_rules.judge(table(spark, folder, "pages"), url_rules.rule_table(spark, RULES))


def op4_embedding_forest(spark, folder):
    """Links and components of embeddings with one label and a cosine of at least 0.93."""
    return forest.near_duplicates(table(spark, folder, "embeddings"), cosine=0.93)


def op5_jaccard_join(spark, folder):
    """Class of every document under links of at least 0.9 between sets of three-word shingles."""
    return jaccard.components(table(spark, folder, "documents"), size=3, num=90, den=100)


def op6_chat_format(spark, folder):
    """Digests of every formatted conversation, read back from its segments."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    return chat.summarize(turns.unionByName(extra))


def op7_language_model(spark, folder):
    """Scores of every text, learnt from four fifths of them."""
    documents = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return language_model.fit_and_score(documents, held_out, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op8_toxicity(spark, folder):
    """Toxicity of every document, learnt from four fifths of the labelled ones."""
    documents = table(spark, folder, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = toxicity.fit(documents, table(spark, folder, "labels"), fold != 0)
    return toxicity.score(documents, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op9_decontaminate(spark, folder):
    """Benchmark items in documents, one row for each document and item."""
    return decontaminate.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_secrets(spark, folder):
    """Secrets in every text: what the patterns match, and what the network adds."""
    found = stored(secrets.findings(table(spark, folder, "documents")))
    spans = secrets.scan(found, secrets.fit(found))
    return spans.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_model"
    )


def op11_whitening(spark, folder):
    """Embeddings whitened along 16 components that distinct vectors are fitted by."""
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_bpe_automaton(spark, folder):
    """Every text encoded by the automaton and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe_automaton.encode(table(spark, folder, "documents"), path)
    return bpe_automaton.decode(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark, folder):
    """Interactions of five filters by source, over the files of documents as a stream."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return filter_audit.audit(spark, f"{folder}/documents.parquet", labels)


def queries() -> dict[str, Query]:
    found = (
        op1_token_records,
        op2_byte_bpe,
        op3_url_rules,
        op4_embedding_forest,
        op5_jaccard_join,
        op6_chat_format,
        op7_language_model,
        op8_toxicity,
        op9_decontaminate,
        op10_secrets,
        op11_whitening,
        op12_bpe_automaton,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found}


# Tables of fixed rules are written out, and the parts of a url are taken by the same patterns.
_URL_RULES = """
WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, h || p) AS place
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT host, path, rule, v FROM fits WHERE place = 1) USING (host, path)
"""


# Rows of one text, part and mask are counted first; then every order of the filters is walked step by step.
_FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marked AS (
  SELECT part,
    len(words) < 200 AS a,
    100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad
  FROM texts LEFT JOIN (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) l USING (doc_id)),
cells AS (
  SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, good, bad, count(*) AS n
  FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
    JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
walked AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, good, bad, n,
    fails[filter_order[step]] AS failed,
    list_bool_or([fails[filter_order[k]] FOR k IN range(1, step)]) IS TRUE AS gone,
    len([f FOR f IN map_values(fails) IF f]) AS failures
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, letter,
    CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed AND failures = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (failed AND NOT gone AND bad), 0) AS BIGINT) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return {"op3_url_rules": _URL_RULES.format(rules=rules), "op13_filter_audit": _FILTER_AUDIT}
