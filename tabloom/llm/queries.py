"""The operators as named queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    divergence, embed_dedup, licenses, packing, piece_bpe, quality, resampling, secrets, simhash, token_counts, toxicity,
    training_order, warc,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op4_piece_bpe")
def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query(
    "op7_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> keeper THEN keeper END AS refers_to
    FROM k""",
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


@query(
    "op8_embed_dedup",
    f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= {embed_dedup.THRESHOLD}),
    r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e
    JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = e.vec_id
    LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY x) n ON n.x = e.vec_id""",
)
def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_training_order")
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _share_sql(n: str, all_n: str) -> str:
    return f"CAST(1 + {divergence.UNIT}::HUGEINT * ({n} + {divergence.SMOOTH}) // ({all_n} + {divergence.SMOOTH} * v) AS BIGINT)"


@query(
    "op11_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
    w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '{_TERMS}')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {divergence.LEAST_DOCS}),
    size_of AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    o AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS all_n FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, {_share_sql("coalesce(o.n, 0)", "gn.all_n")} AS p
        FROM g JOIN k USING (lang) JOIN gn USING (lang, source) JOIN size_of USING (lang) LEFT JOIN o USING (lang, source, term)),
    ln AS (SELECT lang, sum(all_n) AS all_n FROM gn GROUP BY lang),
    q AS (SELECT lang, term, {_share_sql("sum(n)", "any_value(ln.all_n)").replace("* v)", "* any_value(v))")} AS q
        FROM o JOIN ln USING (lang) JOIN size_of USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
        SELECT lang, source, 'pair' AS part, item, value,
            row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value,
            row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}""",
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


@query(
    "op12_resampling",
    rf"""
    WITH RECURSIVE crc AS (
      SELECT i AS b, i AS x, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM crc WHERE k <
      8),
    step AS (SELECT list(x ORDER BY b) AS t FROM crc WHERE k = 8),
    d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS_SQL} AS w FROM documents),
    e AS (SELECT 0 AS i, {_WORDS_SQL} AS w FROM benchmark),
    f AS (SELECT i, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])))
      AS feature FROM (SELECT i, w FROM d UNION ALL SELECT i, w FROM e)),
    n AS (SELECT i, feature, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT feature, xor(list_reduce(list_transform(range(1, 2 * octet_length(encode(feature)), 2), lambda j:
      ('0x' || substr(hex(encode(feature)), j, 2))::BIGINT), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]),
      4294967295), 4294967295) % {resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM n), step),
    c AS (SELECT bucket, sum(n) FILTER (i > 0) AS s, sum(n) FILTER (i = 0) AS t FROM n JOIN b USING (feature) GROUP
      BY bucket),
    a AS (SELECT coalesce(sum(s), 0) + {resampling.BUCKETS} AS s_all, coalesce(sum(t), 0) + {resampling.BUCKETS} AS
      t_all FROM c),
    g AS (SELECT bucket, floor({resampling.SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((coalesce(s, 0) +
      1)::DOUBLE * t_all)))::BIGINT AS gain FROM c, a),
    w AS (SELECT i, sum(n * gain) AS total, sum(n) AS n FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE i
      > 0 GROUP BY i),
    s AS (SELECT i, doc_id, len(d.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n),
      0)::BIGINT AS weight,
       floor(-{resampling.SCALE} * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT +
      0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN w USING (i)),
    r AS (SELECT *, weight + noise AS score, count(*) FILTER (n_words >= {resampling.LEAST_WORDS}) OVER () AS fit,
      row_number() OVER (PARTITION BY n_words >= {resampling.LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS
      place FROM s)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {resampling.LEAST_WORDS} AND place <=
      {resampling.PERCENT} * fit // 100 THEN place END AS rank, n_words::BIGINT AS n_words FROM r""",
)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    """Every window against every notice, without an index."""
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    notices = ", ".join(
        f"({i}, '{label}', {own}, {licenses._window(notice)}, {licenses._least(own, licenses.CONTAINMENT)})"
        for i, (label, notice) in enumerate(licenses.NOTICES)
        for own in [licenses._tokens(notice)]
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS_SQL} AS w FROM documents),
    phrase(p, label) AS (VALUES {phrases}),
    notice(k, label, own, size, least) AS (VALUES {notices}),
    place AS (SELECT i, pos, label FROM (SELECT i, w, unnest(range(len(w))) AS pos FROM d)
        JOIN phrase ON w[pos + 1] = p[1] AND w[pos + 1 : pos + len(p)] = p),
    base AS (SELECT i, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM place GROUP BY i),
    block AS (SELECT i, size, w[pos + 1 : pos + size] AS b FROM (
        SELECT i, size, w, unnest(range(0, greatest(len(w) - size // 2, 1), size // 2)) AS pos FROM d, (SELECT DISTINCT size FROM notice))),
    met AS (SELECT i, k, label, own, least, len(list_intersect(own, b)) AS shared FROM block JOIN notice USING (size)),
    more AS (SELECT i, list(DISTINCT label) AS more, max(shared / len(own)) AS share, count(DISTINCT k) AS notices
        FROM met WHERE shared >= least GROUP BY i)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score, coalesce(notices, 0) AS notices
    FROM d LEFT JOIN base USING (i) LEFT JOIN more USING (i)"""


@query("op13_licenses", _license_sql())
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))
