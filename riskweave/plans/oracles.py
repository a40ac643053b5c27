"""The catalogue's queries as plain SQL over the same tables, written independently."""

from riskweave.functions import text as text_rules
from riskweave.functions.text import ENGLISH_STOP_WORDS, PUNCTUATION, WHITESPACE
from riskweave.operators import words
from riskweave.plans import catalog


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows, columns) -> str:
    body = ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

STRIPPED = (
    "[trim(w, " + _text(PUNCTUATION) + ") FOR w IN string_split_regex("
    "trim(regexp_replace(lower(text), '\\p{Nd}+', ' ', 'g'), " + _text(WHITESPACE) + "), "
    + _text(SPACE_CLASS) + ")]"
)

NOTES = """
notes AS (
  SELECT doc_id AS note_id, doc_id // 4 AS subject_id, text,
         CASE WHEN doc_id % 17 <> 0 THEN DATE '1995-01-01' + CAST((doc_id * 37) % 2400 AS INTEGER) END AS event_date
  FROM documents)"""

TOKENS = f"""
{NOTES},
raw_tokens AS (SELECT note_id, subject_id, event_date, unnest({STRIPPED}) AS word FROM notes),
tokens AS (SELECT * FROM raw_tokens WHERE word <> '')"""

CLEAN = f"""
{TOKENS},
lemmas AS {_values(catalog.LEMMAS, "form, lemma")},
lemmatised AS (
  SELECT note_id, subject_id, event_date, coalesce(lemma, word) AS word
  FROM tokens LEFT JOIN lemmas ON form = word),
clean AS (SELECT * FROM lemmatised WHERE word NOT IN {_list(ENGLISH_STOP_WORDS)}),
bags AS (SELECT subject_id, word, CAST(count(*) AS BIGINT) AS cnt FROM clean GROUP BY ALL)"""

UNLEMMATISED_BAGS = f"""
word_sums AS (
  SELECT subject_id, word, CAST(count(*) AS BIGINT) AS cnt FROM tokens
  WHERE word NOT IN {_list(ENGLISH_STOP_WORDS)} GROUP BY ALL)"""


def _scores(bags: str, name: str, norm: str = "count(*)") -> str:
    return f"""
{name} AS (
  SELECT b.subject_id, b.word, b.cnt, t.n AS term_count, f.n AS doc_freq,
         b.cnt / t.norm * ln((s.n + 1) / (f.n + 1)) AS tfidf
  FROM {bags} b
  JOIN (SELECT subject_id, count(*) AS n, {norm} AS norm FROM {bags} GROUP BY ALL) t USING (subject_id)
  JOIN (SELECT word, count(*) AS n FROM {bags} GROUP BY ALL) f USING (word)
  CROSS JOIN (SELECT count(DISTINCT subject_id) AS n FROM {bags}) s)"""


NOTE_SCORES = """
note_bags AS (SELECT note_id AS subject_id, word, CAST(count(*) AS BIGINT) AS cnt FROM clean GROUP BY ALL),
""" + _scores("note_bags", "raw_note_scores") + """,
note_scores AS (SELECT subject_id AS note_id, word, tfidf FROM raw_note_scores)"""


EVENTS = """
admissions AS MATERIALIZED (
  SELECT o_custkey AS subject_id,
         CASE WHEN c_acctbal < 0 AND place = 1 THEN CAST(o_orderdate AS DATE) END AS deathtime,
         CASE WHEN c_acctbal < 0 AND place = 1 THEN '1' WHEN c_acctbal >= 0 OR c_custkey % 2 = 0 THEN '0' END
           AS hospital_expire_flag
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
        FROM orders) o
  JOIN customer ON c_custkey = o_custkey),
diagnoses AS (
  SELECT o_custkey AS subject_id, 'DIAG' || o_orderpriority AS code, CAST(o_orderdate AS DATE) AS event_date
  FROM orders),
lines AS MATERIALIZED (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
medication AS (
  SELECT o_custkey AS subject_id, 'MED' || p_brand AS code, CAST(o_orderdate AS DATE) AS event_date FROM lines),
labs AS (
  SELECT o_custkey AS subject_id, 'LAB' || p_type AS code, l_quantity AS value,
         CAST(l_shipdate AS DATE) AS event_date
  FROM lines),
events_all AS MATERIALIZED (
  SELECT subject_id, 'DIAG' AS source, code, CAST(1 AS DOUBLE) AS value, event_date FROM diagnoses
  UNION ALL SELECT subject_id, 'MED', code, 1.0, event_date FROM medication
  UNION ALL SELECT subject_id, 'LAB', code, value, event_date FROM labs),
labels_all AS (
  SELECT subject_id, CASE WHEN sum(CAST(hospital_expire_flag AS INTEGER)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM admissions GROUP BY subject_id)"""

ENTITIES_WITH_LAST_WINDOW = {
    "disjoint": "ANTI JOIN (SELECT subject_id FROM admissions WHERE hospital_expire_flag = '1') USING (subject_id)",
    "survivor_rows": "SEMI JOIN (SELECT subject_id FROM admissions WHERE hospital_expire_flag = '0') USING (subject_id)",
    "all_entities": "",
}


def _windows(policy: str = "disjoint", lead: int = 0) -> str:
    return f"""
windows AS MATERIALIZED (
  SELECT subject_id, deathtime - 2030 AS start_date, deathtime - 30 AS end_date
  FROM admissions WHERE hospital_expire_flag = '1'
  UNION ALL
  SELECT subject_id, max(event_date) - {2000 + lead}, max(event_date) - {lead}
  FROM events_all {ENTITIES_WITH_LAST_WINDOW[policy]} GROUP BY subject_id)"""


INSIDE = "event_date > start_date AND event_date < end_date"


def _kept(table: str, columns: str, policy: str = "disjoint", inside: str = INSIDE) -> str:
    return f"""
WITH {EVENTS}, {_windows(policy)}
SELECT {columns} FROM {table} JOIN windows USING (subject_id) WHERE {inside}"""


MANY_WINDOWS = f"""
WITH {EVENTS},
last_days AS (SELECT subject_id, max(event_date) AS day FROM events_all GROUP BY subject_id),
many AS MATERIALIZED (
  SELECT subject_id, CAST(w AS INTEGER) AS "window",
         day - CAST(w * {catalog.WINDOW_STEP} + 10 + w % 5 * {catalog.WINDOW_GROWTH} AS INTEGER) AS start_date,
         day - CAST(w * {catalog.WINDOW_STEP} AS INTEGER) AS end_date
  FROM last_days, unnest(range({catalog.MANY_WINDOWS})) AS t(w))
SELECT subject_id, "window", start_date, end_date, source,
       count(*) AS n_events, sum(value) AS total
FROM events_all JOIN many USING (subject_id)
WHERE event_date > start_date AND event_date <= end_date
GROUP BY ALL"""


TUPLES_OF = """
SELECT subject_id, source, code AS feature,
       CASE WHEN source = 'LAB' THEN avg(value) ELSE sum(value) END AS value
FROM {events} GROUP BY subject_id, source, code"""


def _pipeline(variant: str, policy: str = "disjoint", filter_notes: bool = True) -> str:
    """CTEs that end with ``tuples``."""
    kept_notes = (
        f"SELECT note_id, c.subject_id, event_date, word FROM clean c JOIN windows w "
        f"ON w.subject_id = c.subject_id AND {INSIDE}"
        if filter_notes
        else "SELECT * FROM clean"
    )
    head = f"""{EVENTS}, {_windows(policy)},
kept AS (SELECT subject_id, source, code, value FROM events_all JOIN windows USING (subject_id) WHERE {INSIDE}),
coded AS ({TUPLES_OF.format(events="kept")})"""
    if variant == "baseline":
        return head + ", tuples AS (SELECT * FROM coded)"
    head += f""", {CLEAN},
kept_words AS ({kept_notes}),
kept_bags AS (SELECT subject_id, word, count(*) AS cnt FROM kept_words GROUP BY ALL)"""
    if variant == "wordcount":
        text = "SELECT subject_id, 'WORD', word, CAST(cnt AS DOUBLE) FROM kept_bags"
    else:
        head += "," + _scores("kept_bags", "scores")
        text = "SELECT subject_id, 'WORD', word, tfidf FROM scores"
    return head + f", tuples AS (SELECT * FROM coded UNION ALL {text})"


ROUNDED = "SELECT subject_id, source, feature, round(value, 6) AS value FROM "

INDEX = """
names AS (SELECT DISTINCT source, feature FROM tuples),
feature_idx AS (
  SELECT source, feature, CAST(row_number() OVER (ORDER BY source, feature) - 1 AS INTEGER) AS idx FROM names)"""

PREDICTIONS = f"""
{EVENTS},
pairs AS (
  SELECT variant, model FROM (VALUES ('baseline'), ('wordcount'), ('tfidf')) v(variant),
       (VALUES ('logistic'), ('tree'), ('gbt')) m(model)),
predictions AS (
  SELECT variant, model, subject_id, label,
         CASE WHEN CAST('0x' || substr(md5(variant || ':' || model || ':' || subject_id), 1, 8) AS BIGINT) % 10 < 8
              THEN label ELSE 1 - label END AS prediction
  FROM labels_all, pairs),
cells AS (
  SELECT variant, model,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS c00,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS c01,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS c10,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS c11
  FROM predictions GROUP BY ALL),
rates AS (SELECT *, c00 / (c00 + c01) AS recall_0, c11 / (c10 + c11) AS recall_1 FROM cells)"""

COHORT = f"""
cohort AS (
  SELECT DISTINCT subject_id FROM diagnoses
  WHERE substr(code, 5) BETWEEN '{catalog.COHORT_LOW}' AND '{catalog.COHORT_HIGH}')"""


SPLIT = """
split AS (
  SELECT c_custkey AS subject_id,
         CASE WHEN CAST('0x' || substr(md5('6250:' || c_custkey), 1, 8) AS BIGINT) % 10 < 6
              THEN 'train' ELSE 'test' END AS split
  FROM customer)"""


COMMON_INDEX = f"""
names AS (
  SELECT source, feature FROM tuples GROUP BY ALL HAVING count(DISTINCT subject_id) >= {catalog.MIN_ENTITIES}),
feature_idx AS (
  SELECT source, feature, CAST(row_number() OVER (ORDER BY source, feature) - 1 AS INTEGER) AS idx FROM names)"""


def _examples(variant: str, index: str = INDEX) -> str:
    return f"""
WITH {_pipeline(variant)}, {index}, {SPLIT}
SELECT subject_id, label, split, CAST((SELECT count(*) FROM feature_idx) AS INTEGER) AS size, idx,
       round(value, 6) AS value
FROM tuples JOIN feature_idx USING (source, feature) JOIN labels_all USING (subject_id) JOIN split USING (subject_id)"""


def _unwindowed(variant: str) -> str:
    head = f"WITH {EVENTS}, coded AS ({TUPLES_OF.format(events='events_all')})"
    if variant == "baseline":
        return f"{head} {ROUNDED} coded"
    if variant == "wordcount":
        head += f", {TOKENS}, {UNLEMMATISED_BAGS}"
        text = "SELECT subject_id, 'WORD', word, CAST(cnt AS DOUBLE) FROM word_sums"
    else:
        head += f", {CLEAN}, {NOTE_SCORES}"
        text = "SELECT note_id // 4, 'WORD', word, avg(tfidf) FROM note_scores GROUP BY ALL"
    return f"{head}, tuples AS (SELECT * FROM coded UNION ALL {text}) {ROUNDED} tuples"


def _treebank() -> str:
    text = f"regexp_replace(regexp_replace(text, {_text(text_rules.TREEBANK_SPACE)}, ' ', 'g'), ' +\\z', '')"
    for at, (pattern, put) in enumerate(text_rules.TREEBANK_RULES):
        if at == text_rules.TREEBANK_PADDED:
            text = f"(' ' || {text} || ' ')"
        text = f"regexp_replace({text}, {_text(pattern)}, {_text(put)}, 'g')"
    pairs = ", ".join(f"({_text(a + b)}, {len(a)})" for a, b in text_rules.TREEBANK_PAIRS)
    return f"""
WITH {NOTES},
pairs(whole, cut) AS (VALUES {pairs}),
words AS (SELECT note_id, unnest(string_split_regex({text}, ' +')) AS word FROM notes)
SELECT note_id, unnest(CASE WHEN cut IS NULL THEN [word] ELSE [left(word, cut), substr(word, cut + 1)] END) AS word
FROM words LEFT JOIN pairs ON whole = lower(word) WHERE word <> ''"""


def oracle_sql() -> dict[str, str]:
    found = {
        "code_namespace": """
SELECT o_orderkey,
       'DIAG' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE o_orderpriority END AS diag_code,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 'DIAG' || o_orderpriority END AS diag_or_null,
       'MED' || o_orderstatus AS med_code,
       'LAB' || CAST(o_custkey AS VARCHAR) AS lab_code
FROM orders""",
        "date_truncation": """
SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) AS day_again FROM events""",
        "number_casts": """
SELECT event_id, value AS as_double, CAST(user_id AS INTEGER) AS as_int,
       CAST(NULL AS DOUBLE) AS bad_double, CAST(NULL AS INTEGER) AS bad_int
FROM events""",
        "normalize_text": f"WITH {NOTES} SELECT note_id, array_to_string({STRIPPED}, ' ') AS text FROM notes",
        "tokenize": f"WITH {TOKENS} SELECT note_id, word FROM tokens",
        "tokenize_endings": f"""
WITH {TOKENS},
ends AS (SELECT note_id, word, len(word) > 4 AND word LIKE '%tion' AS cut FROM tokens),
pieces AS (
  SELECT note_id, unnest(CASE WHEN cut THEN [left(word, len(word) - 4), 'tion'] ELSE [word] END) AS word FROM ends)
SELECT * FROM pieces""",
        "lemmatize": f"WITH {CLEAN} SELECT note_id, word FROM lemmatised",
        "remove_stopwords": f"WITH {CLEAN} SELECT note_id, word FROM clean",
        "note_word_count": f"""
WITH {CLEAN}
SELECT note_id, subject_id, event_date, word, CAST(count(*) AS BIGINT) AS cnt FROM clean GROUP BY ALL""",
        "note_word_count_plain": f"""
WITH {TOKENS}
SELECT note_id, subject_id, event_date, word, CAST(count(*) AS BIGINT) AS cnt FROM tokens GROUP BY ALL""",
        "split_outcome": f"""
WITH {EVENTS}
SELECT *, CASE hospital_expire_flag WHEN '1' THEN 'deceased' WHEN '0' THEN 'survived' ELSE 'undetermined' END AS outcome FROM admissions""",
        "drop_incomplete": f"WITH {EVENTS} SELECT * FROM labs WHERE value <> 1",
        "drop_nan_time": f"""
WITH {NOTES}
SELECT note_id, strftime(event_date, '%Y-%m-%d') AS charttime FROM notes WHERE event_date IS NOT NULL""",
        "events_in_window_diag": _kept("diagnoses", "subject_id, code, event_date"),
        "events_in_window_med": _kept("medication", "subject_id, code, event_date"),
        "events_in_window_lab": _kept("labs", "subject_id, code, value, event_date"),
        "events_in_window_note": f"""
WITH {EVENTS}, {_windows()}, {NOTES}
SELECT note_id, subject_id, event_date FROM notes JOIN windows USING (subject_id) WHERE {INSIDE}""",
        "events_in_window_hot": _kept("events_all", "subject_id, source, code, value, event_date"),
        "events_in_many_windows": MANY_WINDOWS,
        "events_in_many_windows_hot": MANY_WINDOWS,
        "events_in_closed_window": _kept(
            "events_all",
            "subject_id, source, code, value, event_date",
            inside="event_date BETWEEN start_date AND end_date",
        ),
        "feature_count_filtered": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, CAST(count(*) AS DOUBLE) AS value FROM diagnoses
WHERE code IN {_list(catalog.WANTED_DIAGNOSES)} GROUP BY ALL""",
        "feature_count_listed": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, CAST(count(*) AS DOUBLE) AS value FROM medication
WHERE code IN (SELECT 'MED' || p_brand FROM part WHERE p_size >= {catalog.BIG_PARTS}) GROUP BY ALL""",
        "feature_avg_filtered": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, avg(value) AS value FROM labs
WHERE code IN {_list(catalog.WANTED_LABS)} GROUP BY ALL""",
        "cohort_events_hot": f"""
WITH {EVENTS}, {COHORT}
SELECT * FROM events_all WHERE subject_id IN (SELECT subject_id FROM cohort)""",
        "csv_admissions": f"""
WITH {EVENTS}
SELECT CAST(subject_id AS VARCHAR) AS subject_id, deathtime, hospital_expire_flag FROM admissions""",
        "csv_events": """
WITH lines AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey % 7 <> 0)
SELECT CAST(o_custkey AS VARCHAR) AS subject_id, 'DIAG' AS source, 'DIAG' || o_orderpriority AS code,
       CAST(1 AS DOUBLE) AS value, CAST(o_orderdate AS DATE) AS event_date
FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), 'MED', 'MED' || p_brand, 1.0, CAST(o_orderdate AS DATE) FROM lines
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), 'LAB', 'LAB' || p_type, l_quantity, CAST(l_shipdate AS DATE)
FROM lines WHERE l_linenumber <> 3""",
        "csv_view": """
SELECT CAST(n_regionkey AS VARCHAR) AS region, count(*) AS n FROM nation GROUP BY ALL""",
        "csv_notes": f"""
WITH {NOTES}
SELECT CAST(subject_id AS VARCHAR) AS subject_id, event_date, '"note"' || chr(10) || text AS text FROM notes""",
        "csv_notes_split": f"""
WITH {NOTES}
SELECT CAST(subject_id AS VARCHAR) AS subject_id, event_date, '"note"' || chr(10) || text AS text FROM notes""",
        "table_notes": f"WITH {NOTES} SELECT note_id, subject_id, event_date, text FROM notes",
        "csv_word_counts": f"""
WITH {CLEAN}
SELECT CAST(subject_id AS VARCHAR) AS subject_id, word, CAST(count(*) AS BIGINT) AS cnt, event_date
FROM clean WHERE event_date IS NOT NULL GROUP BY note_id, subject_id, word, event_date""",
        "csv_tfidf": f"""
WITH {CLEAN}, {_scores("bags", "scores")}
SELECT CAST(subject_id AS VARCHAR) AS subject_id, word, round(tfidf, 6) AS tfidf FROM scores""",
        "metrics_lines": f"""
WITH {PREDICTIONS}
SELECT variant, model, round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT variant, model, unnest([(c00 + c11) / (c00 + c01 + c10 + c11), (recall_0 + recall_1) / 2,
                                     c00, c01, c10, c11]) AS value FROM rates)""",
        "cohort_select": f"WITH {EVENTS}, {COHORT} SELECT subject_id FROM cohort",
        "cohort_events": f"""
WITH {EVENTS}, {COHORT}
SELECT * FROM events_all WHERE subject_id IN (SELECT subject_id FROM cohort)""",
        "windows_lead_survivors": f"WITH {EVENTS}, {_windows(lead=30)} SELECT * FROM windows",
        "windows_with_notes": f"""
WITH {EVENTS}, {_windows()}, {NOTES},
alive AS (SELECT subject_id, event_date FROM events_all UNION ALL SELECT subject_id, event_date FROM notes),
last AS (
  SELECT subject_id, max(event_date) AS day FROM alive
  {ENTITIES_WITH_LAST_WINDOW["disjoint"]} GROUP BY subject_id HAVING max(event_date) IS NOT NULL)
SELECT w.* FROM windows w WHERE subject_id IN (SELECT subject_id FROM admissions WHERE hospital_expire_flag = '1')
UNION ALL SELECT subject_id, day - 2000, day FROM last""",
        "event_dates": f"WITH {EVENTS} SELECT DISTINCT subject_id, event_date FROM events_all",
        "last_event_date_activity": f"""
WITH {EVENTS} SELECT subject_id, max(event_date) AS last_date FROM events_all GROUP BY ALL""",
        "last_event_date": f"""
WITH {EVENTS} SELECT subject_id, max(event_date) AS last_date FROM events_all GROUP BY ALL""",
        "feature_count_diag": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, CAST(count(*) AS DOUBLE) AS value FROM diagnoses GROUP BY ALL""",
        "feature_count_med": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, CAST(count(*) AS DOUBLE) AS value FROM medication GROUP BY ALL""",
        "feature_avg_lab": f"""
WITH {EVENTS}
SELECT subject_id, code AS feature, round(avg(value), 6) AS value FROM labs GROUP BY ALL""",
        "feature_sum_word": f"""
WITH {TOKENS}, {UNLEMMATISED_BAGS}
SELECT subject_id, word AS feature, CAST(cnt AS DOUBLE) AS value FROM word_sums""",
        "feature_avg_tfidf": f"""
WITH {CLEAN}, {NOTE_SCORES}
SELECT note_id // 4 AS subject_id, word AS feature, round(avg(tfidf), 6) AS value FROM note_scores GROUP BY ALL""",
        "feature_vocabulary_size": f"""
WITH {_pipeline("wordcount")}
SELECT count(*) AS n_features FROM (SELECT DISTINCT source, feature FROM tuples)""",
        "feature_index": f"WITH {_pipeline('wordcount')}, {INDEX} SELECT source, feature, idx FROM feature_idx",
        "feature_index_common": f"""
WITH {_pipeline("wordcount")},
names AS (SELECT source, feature FROM tuples GROUP BY ALL HAVING count(DISTINCT subject_id) >= {catalog.MIN_ENTITIES})
SELECT source, feature, CAST(row_number() OVER (ORDER BY source, feature) - 1 AS INTEGER) AS idx FROM names""",
        "sparse_rows": f"""
WITH {_pipeline("wordcount")}, {INDEX}
SELECT subject_id, idx, round(value, 6) AS value,
       CAST(row_number() OVER (PARTITION BY subject_id ORDER BY idx) - 1 AS INTEGER) AS position
FROM tuples JOIN feature_idx USING (source, feature)""",
        "sparse_rows_hot": f"""
WITH {_pipeline("wordcount")}, {INDEX}
SELECT subject_id, idx, round(value, 6) AS value FROM tuples JOIN feature_idx USING (source, feature)""",
        "feature_vectors": _examples("baseline"),
        "feature_vectors_wordcount": _examples("wordcount"),
        "feature_vectors_common": _examples("wordcount", COMMON_INDEX),
        "test_examples": f"""
WITH {_pipeline("baseline")}, {SPLIT}
SELECT subject_id, label FROM (SELECT DISTINCT subject_id FROM tuples) JOIN labels_all USING (subject_id)
JOIN split USING (subject_id) WHERE split = 'test'""",
        "entity_word_count": f"WITH {CLEAN} SELECT subject_id, word, cnt FROM bags",
        "entity_term_count": f"""
WITH {CLEAN}
SELECT subject_id, count(*) AS term_count, CAST(sum(cnt) AS BIGINT) AS token_count FROM bags GROUP BY ALL""",
        "document_frequency": f"WITH {CLEAN} SELECT word, count(*) AS doc_freq FROM bags GROUP BY ALL",
        "corpus_size": f"""
WITH {CLEAN}
SELECT count(DISTINCT subject_id) AS n_entities, count(DISTINCT word) AS n_words FROM bags""",
        "entity_tfidf": f"""
WITH {CLEAN}, {_scores("bags", "scores")}
SELECT subject_id, word, cnt, term_count, doc_freq, round(tfidf, 6) AS tfidf FROM scores""",
        "entity_tfidf_hot": f"""
WITH {CLEAN}, {_scores("bags", "scores")}
SELECT subject_id, word, cnt, term_count, doc_freq, round(tfidf, 6) AS tfidf FROM scores""",
        "entity_tfidf_total_tokens": f"""
WITH {CLEAN}, {_scores("bags", "scores", "sum(cnt)")}
SELECT subject_id, word, cnt, term_count, doc_freq, round(tfidf, 6) AS tfidf FROM scores""",
        "entity_label": f"WITH {EVENTS} SELECT subject_id, label FROM labels_all",
        "labeled_tuples": f"""
WITH {_pipeline("baseline")}
SELECT subject_id, source, feature, round(value, 6) AS value, label FROM tuples JOIN labels_all USING (subject_id)""",
        "hash_split": f"WITH {SPLIT} SELECT * FROM split",
        "split_by_ids": f"""
WITH {EVENTS}
SELECT subject_id, label, 'train' AS split FROM labels_all
WHERE subject_id IN (SELECT c_custkey FROM customer
                     WHERE c_nationkey BETWEEN {catalog.TRAIN_NATIONS[0]} AND {catalog.TRAIN_NATIONS[1]})
UNION ALL
SELECT subject_id, label, 'test' FROM labels_all
WHERE subject_id IN (SELECT c_custkey FROM customer
                     WHERE c_nationkey BETWEEN {catalog.TEST_NATIONS[0]} AND {catalog.TEST_NATIONS[1]})""",
        "cohort_stats": f"""
WITH {EVENTS}, {COHORT}, {NOTES},
described AS (
  SELECT subject_id, (SELECT count(*) FROM notes n WHERE n.subject_id = c.subject_id) AS n,
         coalesce(label, 0) AS label
  FROM cohort c LEFT JOIN labels_all USING (subject_id))
SELECT count(*) AS n_cohort, round(avg(n), 6) AS notes_mean, min(n) AS notes_min, max(n) AS notes_max,
       count(*) FILTER (WHERE n = 0) AS n_without_notes, count(*) FILTER (WHERE label > 0) AS n_deceased,
       round(avg(label), 6) AS share_deceased,
       (SELECT count(DISTINCT c_custkey) FROM customer) AS n_all,
       (SELECT count(*) FROM (SELECT DISTINCT source, code FROM events_all)) AS n_features
FROM described""",
        "cluster_purity": """
SELECT round(sum(largest) / sum(size), 6) AS purity
FROM (SELECT p_brand, max(n) AS largest, sum(n) AS size
      FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand)""",
        "eval_accuracy": f"""
WITH {PREDICTIONS}
SELECT variant, model, round((c00 + c11) / (c00 + c01 + c10 + c11), 6) AS accuracy FROM cells""",
        "eval_confusion": f"WITH {PREDICTIONS} SELECT * FROM cells",
        "eval_auroc_hard": f"""
WITH {PREDICTIONS} SELECT variant, model, round((recall_0 + recall_1) / 2, 6) AS auroc_hard FROM rates""",
        "eval_class_recall": f"""
WITH {PREDICTIONS}
SELECT variant, model, round(recall_0, 6) AS recall_0, round(recall_1, 6) AS recall_1 FROM rates""",
        "eval_report": f"""
WITH {PREDICTIONS}
SELECT variant, model, round((c00 + c11) / (c00 + c01 + c10 + c11), 6) AS accuracy,
       round((recall_0 + recall_1) / 2, 6) AS auroc_hard, c00, c01, c10, c11
FROM rates""",
        "pipeline_wordcount_all_notes_tuples": f"WITH {_pipeline('wordcount', filter_notes=False)} {ROUNDED} tuples",
    }
    found["eval_auroc_scores"] = f"""
WITH {PREDICTIONS},
scored AS (
  SELECT variant, model, label,
         (CAST('0x' || substr(md5('s:' || variant || ':' || model || ':' || subject_id), 1, 8) AS BIGINT) % 20 + 4 * label) / 20.0 AS score
  FROM predictions),
counted AS (SELECT variant, model, label, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT variant, model,
       round(sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n), 6) AS auroc
FROM counted a JOIN counted b USING (variant, model) WHERE a.label = 1 AND b.label = 0 GROUP BY variant, model"""
    found["vocabulary_growth"] = f"""
WITH {EVENTS},
names AS (
  SELECT source, code AS feature, bool_or(subject_id % 2 = 0 AND source <> 'DIAG') AS first
  FROM events_all GROUP BY source, code)
SELECT source, feature, CAST(row_number() OVER (ORDER BY first DESC, source, feature) - 1 AS INTEGER) AS idx FROM names"""
    found["word_counts_once"] = f"""
WITH {TOKENS} SELECT note_id, word, CAST(count(*) AS BIGINT) AS cnt FROM tokens GROUP BY ALL"""
    spans = _values(catalog.CODE_RANGES, "low, high")
    found["codes_in_ranges"] = f"""
WITH {EVENTS}
SELECT DISTINCT code FROM events_all JOIN {spans} r ON code BETWEEN low AND high"""
    found["cohort_ranges"] = f"""
WITH {EVENTS}
SELECT DISTINCT subject_id FROM events_all JOIN {spans} r ON code BETWEEN low AND high WHERE subject_id % 5 < 3"""
    found["tokenize_treebank"] = _treebank()
    endings = ", ".join(f"('{old}', '{new}')" for old, new in words.NOUN_ENDINGS)
    found["lemmatize_nouns"] = f"""
WITH RECURSIVE {CLEAN},
vocabulary AS (SELECT DISTINCT word FROM tokens),
nouns AS (SELECT word FROM vocabulary WHERE md5(word) < '8'),
endings(old, new) AS (VALUES {endings}),
stems AS (
  SELECT word AS form, word AS stem, 0 AS round FROM vocabulary WHERE word NOT IN (SELECT form FROM lemmas)
  UNION
  SELECT form, left(stem, len(stem) - len(old)) || new, round + 1 FROM stems JOIN endings ON ends_with(stem, old)
  WHERE round < 100),
hits AS (
  SELECT form, stem AS lemma, greatest(round, 1) AS round FROM stems WHERE stem IN (SELECT word FROM nouns)
  UNION ALL
  SELECT form, l, 1 FROM lemmas, unnest([form, lemma]) u(l) WHERE l IN (SELECT word FROM nouns)),
best AS (SELECT form, lemma FROM hits QUALIFY row_number() OVER (PARTITION BY form ORDER BY round, len(lemma), lemma) = 1)
SELECT note_id, coalesce(best.lemma, word) AS word FROM tokens LEFT JOIN best ON form = word"""
    found["remove_stopwords_hot"] = found["remove_stopwords"]
    found["pca_invariants"] = f"""
WITH {_pipeline("wordcount")}, {SPLIT},
train AS (SELECT subject_id FROM (SELECT DISTINCT subject_id FROM tuples) JOIN labels_all USING (subject_id)
          JOIN split USING (subject_id) WHERE split = 'train'),
size AS (SELECT count(*) AS n FROM train),
fitted AS (SELECT source, feature, value FROM tuples WHERE subject_id IN (SELECT subject_id FROM train)),
moments AS (SELECT sum(value) AS s, sum(value * value) AS q FROM fitted GROUP BY source, feature),
sums AS (SELECT sum(q) AS q, sum((s / n) * (s / n)) AS m FROM moments, size)
SELECT n AS n_entities, (SELECT count(*) FROM (SELECT DISTINCT source, feature FROM tuples)) AS n_features,
       round((q - n * m) / (n - 1), 3) AS total_variance, round(m, 3) AS mean_square,
       CAST({catalog.PCA_COMPONENTS} AS BIGINT) AS n_components, true AS centred, true AS variances_agree,
       true AS falling, true AS within_total
FROM sums, size"""
    found["csv_id_split"] = f"SELECT CAST(subject_id AS VARCHAR) AS subject_id, label, split FROM ({found['split_by_ids']})"
    found["metrics_table"] = found["eval_report"]
    for policy in ENTITIES_WITH_LAST_WINDOW:
        found[f"windows_{policy}"] = f"WITH {EVENTS}, {_windows(policy)} SELECT * FROM windows"
        if policy != "disjoint":
            found[f"events_in_window_{policy}"] = _kept(
                "events_all", "subject_id, source, code, value, event_date", policy
            )
            found[f"pipeline_baseline_{policy}_tuples"] = f"WITH {_pipeline('baseline', policy)} {ROUNDED} tuples"
    for variant in ("baseline", "wordcount", "tfidf"):
        found[f"feature_tuples_{variant}"] = _unwindowed(variant)
        found[f"pipeline_{variant}_tuples"] = f"WITH {_pipeline(variant)} {ROUNDED} tuples"
    return found
