"""Word counts and text cleaning."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions.stopwords import ENGLISH, LANGUAGE_NAMES, stop_word_frame, stop_word_union, stop_words
from tabloom.operators.catalog import visible
from tabloom.operators.features import lemmatize_with_table
from tabloom.operators.word_count import top_words

from .base import TOKEN, WS, load, query, sql_list

CODES = ("en", "fr", "de", "es")


def bundled_list(code: str) -> list[str]:
    """Spark's stop-word file for a language, read without a session."""
    if code == "en":
        return list(ENGLISH)
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = sorted(glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")))[0]
    with zipfile.ZipFile(jar) as z:
        return z.read(f"org/apache/spark/ml/feature/stopwords/{LANGUAGE_NAMES[code]}.txt").decode().split()


def word_count_sql(table: str, column: str, where: str = "true") -> str:
    return f"""
    WITH w AS (
      SELECT unnest(regexp_split_to_array(lower({column}), '{WS}')) AS word FROM {table} WHERE {where})
    SELECT word, count(*) AS frequency FROM w
    WHERE word <> '' AND word NOT IN ({sql_list(ENGLISH)})
    GROUP BY word ORDER BY frequency DESC, word LIMIT 50"""


@query("word_count_top50", word_count_sql("documents", "text"))
def word_count_top50(spark, sf):
    return top_words(load(spark, sf, "documents"), "text")


# Stand-ins for the catalogs: permission 0 or 2 is visible, hidden rows are not.
PART_PERMISSION = "CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 1 WHEN p_type = 'PROMO' THEN 2 ELSE 0 END"
CUSTOMER_PERMISSION = "CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 0 ELSE 2 END"
ROLE_PERMISSION = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 2 ELSE 1 END"
MODEL_PERMISSION = "CASE WHEN p_size <= 25 THEN 0 ELSE 1 END"


def visible_words(spark, sf, table, column, permission=None, hidden=None, public=None):
    rows = load(spark, sf, table)
    names = {}
    for name, expr in (("permission", permission), ("hidden", hidden), ("public", public)):
        if expr:
            rows, names[name] = rows.withColumn(f"_{name}", F.expr(expr)), f"_{name}"
    return top_words(visible(rows, **names), column)


@query(
    "word_count_datasets",
    word_count_sql("part", "p_name", f"{PART_PERMISSION} IN (0, 2) AND NOT (p_size > 45)"),
)
def word_count_datasets(spark, sf):
    return visible_words(spark, sf, "part", "p_name", PART_PERMISSION, "p_size > 45")


@query(
    "word_count_feature_groups",
    word_count_sql("customer", "c_mktsegment", f"{CUSTOMER_PERMISSION} IN (0, 2) AND NOT (c_nationkey = 24)"),
)
def word_count_feature_groups(spark, sf):
    return visible_words(spark, sf, "customer", "c_mktsegment", CUSTOMER_PERMISSION, "c_nationkey = 24")


@query("word_count_notebooks", word_count_sql("documents", "text", "lang = 'en'"))
def word_count_notebooks(spark, sf):
    return visible_words(spark, sf, "documents", "text", public="lang = 'en'")


@query("word_count_file_management", word_count_sql("conversations", "text", f"{ROLE_PERMISSION} IN (0, 2)"))
def word_count_file_management(spark, sf):
    return visible_words(spark, sf, "conversations", "text", ROLE_PERMISSION)


@query("word_count_model_zoo", word_count_sql("part", "p_type", f"{MODEL_PERMISSION} IN (0, 2)"))
def word_count_model_zoo(spark, sf):
    return visible_words(spark, sf, "part", "p_type", MODEL_PERMISSION)


@query(
    "stopword_union",
    f"""
    SELECT unnest([{sql_list(ENGLISH)}]) AS word
    UNION
    SELECT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '{WS}')) AS word
                      FROM conversations) WHERE word <> ''""",
)
def stopword_union(spark, sf):
    own = load(spark, sf, "conversations").select(F.explode(T.words(F.lower("text"))).alias("word"))
    return stop_word_union(stop_word_frame(spark, list(ENGLISH)), own)


@query("text_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def text_lower(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.lower_case("text").alias("text"))


TOKENS = f"regexp_extract_all(text, '{TOKEN}', 1)"
MARKS = T.PUNCTUATION.replace("'", "''")
STRIPPED = f"list_transform({TOKENS}, lambda w: translate(w, '{MARKS}', ''))"


def stop_case() -> str:
    lists = " ".join(f"WHEN '{c}' THEN [{sql_list(bundled_list(c))}]" for c in CODES)
    return f"CASE lang {lists} ELSE []::VARCHAR[] END"


@query(
    "text_tokenize",
    f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, array_to_string({TOKENS}, ' ') AS tokens FROM documents",
)
def text_tokenize(spark, sf):
    tokens = T.tokenize("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")
    )


@query("text_strip_punct", f"SELECT doc_id, array_to_string({STRIPPED}, '|') AS words FROM documents")
def text_strip_punct(spark, sf):
    words = T.strip_punctuation(T.tokenize("text"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(words, "|").alias("words"))


@query(
    "text_stopwords",
    lambda: f"""
    SELECT doc_id, lang, array_to_string(
      list_filter(tokens, lambda w: NOT list_contains(stop, lower(w))), ' ') AS words
    FROM (SELECT doc_id, lang, {TOKENS} AS tokens, {stop_case()} AS stop FROM documents)""",
)
def text_stopwords(spark, sf):
    lists = {code: stop_words(code) for code in CODES}
    kept = T.drop_stop_words_by_language(T.tokenize("text"), "lang", lists)
    return load(spark, sf, "documents").select("doc_id", "lang", F.array_join(kept, " ").alias("words"))


def plural_lexicon(documents):
    """Forms ending in s whose stem is a word of the documents too."""
    vocabulary = documents.select(F.explode(F.transform(T.tokenize("text"), F.lower)).alias("form")).distinct()
    stems = vocabulary.select(F.col("form").alias("lemma"))
    forms = vocabulary.where("form like '%s' and length(form) > 3")
    return forms.join(stems, F.expr("substring(form, 1, length(form) - 1) = lemma"))


@query(
    "text_lemmatize",
    f"""
    WITH t AS (SELECT doc_id, list_transform({TOKENS}, lambda w: lower(w)) AS tokens FROM documents),
    v AS (SELECT DISTINCT unnest(tokens) AS form FROM t),
    x AS (SELECT a.form, b.form AS lemma FROM v a JOIN v b ON left(a.form, len(a.form) - 1) = b.form
          WHERE a.form LIKE '%s' AND len(a.form) > 3),
    p AS (SELECT doc_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS w FROM t)
    SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS words
    FROM p LEFT JOIN x ON form = w GROUP BY doc_id""",
)
def text_lemmatize(spark, sf):
    documents = load(spark, sf, "documents")
    tokens = documents.select("doc_id", T.tokenize("text").alias("tokens"))
    done = lemmatize_with_table(tokens, "doc_id", "tokens", plural_lexicon(documents), "lemmas")
    return done.select("doc_id", F.array_join("lemmas", " ").alias("words"))


@query(
    "lemma_null_and_repeated",
    f"""
    WITH t AS (SELECT doc_id, list_transform({TOKENS}, lambda w: lower(w)) AS tokens FROM documents),
    v AS (SELECT DISTINCT unnest(tokens) AS form FROM t),
    p AS (SELECT doc_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS w FROM t)
    SELECT doc_id, string_agg(CASE WHEN len(w) > 5 AND w NOT LIKE '%t' THEN 'a' || w ELSE w END, ' ' ORDER BY i) AS words
    FROM p GROUP BY doc_id""",
)
def lemma_null_and_repeated(spark, sf):
    """A lexicon that lists each form twice, and some with a null lemma."""
    documents = load(spark, sf, "documents")
    tokens = documents.select("doc_id", T.tokenize("text").alias("tokens"))
    forms = documents.select(F.explode(F.transform(T.tokenize("text"), F.lower)).alias("form")).distinct().where("length(form) > 5")
    one = forms.select("form", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("head"))
    given = one.select("form", F.when(~F.col("form").endswith("t"), F.concat("head", "form")).alias("lemma"))
    done = lemmatize_with_table(tokens, "doc_id", "tokens", given, "lemmas")
    return done.select("doc_id", F.array_join("lemmas", " ").alias("words"))


@query(
    "word_count_long_list",
    f"""
    WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '{WS}')) AS word FROM documents),
    s AS (SELECT unnest(regexp_split_to_array(lower(text), '{WS}')) AS word FROM benchmark)
    SELECT word, count(*) AS frequency FROM w
    WHERE word <> '' AND word NOT IN ({sql_list(ENGLISH)}) AND word NOT IN (SELECT word FROM s)
    GROUP BY word ORDER BY frequency DESC, word LIMIT 50""",
)
def word_count_long_list(spark, sf):
    """A second stop list from a table, anti-joined after counting."""
    listed = load(spark, sf, "benchmark").select(F.explode(T.words(F.lower("text"))).alias("word")).distinct()
    return top_words(load(spark, sf, "documents"), "text", stop_frame=listed)


# Fixed value: a few irregular forms, as a caller would give them.
SMALL_LEXICON = {"was": "be", "were": "be", "has": "have", "had": "have", "les": "le", "des": "de"}
LEMMA_CASE = "CASE w " + " ".join(f"WHEN '{f}' THEN '{l}'" for f, l in SMALL_LEXICON.items()) + " ELSE w END"


@query(
    "text_clean",
    lambda: f"""
    SELECT doc_id, array_to_string(list_transform(
      list_filter(list_transform({STRIPPED}, lambda w: lower(w)), lambda w: NOT list_contains({stop_case()}, w)),
      lambda w: {LEMMA_CASE}), ' ') AS text
    FROM documents""",
)
def text_clean(spark, sf):
    cleaned = T.clean_text(
        "text", T.CLEANING_METHODS, stop={c: stop_words(c) for c in CODES}, language="lang", lexicon=SMALL_LEXICON
    )
    return load(spark, sf, "documents").select("doc_id", cleaned.alias("text"))
