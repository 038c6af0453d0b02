"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat, collision_ann, divergence, fixity, hard_negatives, jaccard_join, language_id, packing, quality, recurrent_lm, substring_dedup, wrappers
from shelfmark.llm.tables import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; null or letterless text: und."""
    return language_id.learn_and_predict(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document with a lesser id holds as well."""
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of all pages, laid out as WARC files."""
    return fixity.audit_trial_replica(read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of base rules and boosted trees on every document; null text: no words, not kept."""
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under word counts and under the recurrent model."""
    return recurrent_lm.learn_and_score(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of encoded and decoded text of every document."""
    return bpe.digests(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under shingle similarity of 0.75."""
    return jaccard_join.link_components(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings")
    return collision_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each positive of every vector whose id is divisible by 100."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and trainable text of every conversation, read back from its formatted examples."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, chat.TARGET, said)], "conv_id long, turn long, role string, text string")
    return chat.read_examples(chat.segments(given.unionByName(extra)))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between all sources of a language, and the terms that each source overuses."""
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_quality": op4_quality,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_bpe": op6_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op10_collision_ann": op10_collision_ann,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}

_RECORD = (
    "'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || "
    "'Content-Type: text/html' || crlf || 'Content-Length: ' || strlen(coalesce(html, '')) || crlf || crlf || "
    "coalesce(html, '') || crlf || crlf"
)
_AUDIT = (
    f"WITH r AS (SELECT page_id, page_id // {fixity.RECORDS_PER_FILE} AS file, {_RECORD} AS record FROM pages, (SELECT chr(13) || "
    "chr(10) AS crlf)), d AS (SELECT *, strlen(record) AS length, sha256(record) AS expected FROM r), o AS (SELECT *, CAST(sum(length) "
    "OVER (PARTITION BY file ORDER BY page_id, expected ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS \"offset\" FROM d) SELECT "
    f"page_id, file, \"offset\", length, CASE page_id % {fixity.TRIAL_MODULUS} WHEN {fixity.TRIAL_CHANGED} THEN 'changed' ELSE 'missing' "
    f"END AS status, expected, CASE page_id % {fixity.TRIAL_MODULUS} WHEN {fixity.TRIAL_CHANGED} THEN sha256(substr(record, 1, "
    f"length(record) - 1) || '~') END AS found FROM o WHERE page_id % {fixity.TRIAL_MODULUS} IN ({fixity.TRIAL_CHANGED}, {fixity.TRIAL_MISSING})"
)
_LINKED = (
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents), i AS (SELECT doc_id, l, unnest(range(1, 1 + "
    "greatest(len(l) - 4, least(len(l), 1)))) AS k FROM w), s AS (SELECT DISTINCT doc_id, array_to_string(l[k:k + 4], ' ') AS g FROM i), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b "
    "ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b "
    "WHERE 100 * k >= 75 * (x.n + y.n - k)), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON "
    "e.a = r.doc_id), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, "
    "component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"
)

_MINED = (
    "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: "
    "floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, "
    "lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, "
    "CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 "
    "= 0), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same QUALIFY r <= 5) SELECT p.a AS "
    "anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS "
    "negative_id, p.s AS positive_score, n.s AS negative_score FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND "
    "100 * n.s <= 90 * p.s QUALIFY rank <= 10"
)
#: Code points of a formatted turn: a backslash for each control string, one for each line break or backslash of a role.
_CONTROLS = rf"'({chat.HEADS})(\\*)({chat.TAILS})', '\1\\\2\3', 'g'"
_CHAT = (
    "WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', "
    f"'</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, '{chat.TARGET}', '</s>[INST] ok [/INST]'), f AS (SELECT *, role = '{chat.TARGET}' AS reply, "
    f"length('{chat.OPEN}{chat.CLOSE}') + 2 + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), {_CONTROLS})) + "
    f"length(regexp_replace(text, {_CONTROLS})) AS n FROM t), c AS (SELECT *, sum(n) OVER w AS upto, lead(turn) OVER w IS NULL AS last FROM f "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || "
    "text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS "
    "loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (reply), '')) AS loss_sha256, CAST(sum(upto) FILTER "
    "(reply OR last) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"
)
_DIVERGENCE = (
    "WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate("
    r"coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents), "
    "w AS (SELECT id, lang, source, unnest(l) AS term FROM d), "
    f"k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}), "
    "g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL), "
    "q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) "
    "AS q FROM k), p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // "
    "(sum(coalesce(c.n, 0)) OVER w + count(*) OVER w) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = "
    "g.source AND c.term = k.term WINDOW w AS (PARTITION BY g.lang, g.source)), r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, "
    "coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON "
    "x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL UNION ALL "
    "SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q) SELECT lang, source, part, "
    "item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank "
    f"FROM r QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}"
)

#: Where SQL can express the whole result; the other queries are tested against plain versions.
ORACLES = {"op3_merkle_audit": _AUDIT, "op7_jaccard_join": _LINKED, "op11_hard_negatives": _MINED, "op12_chat_format": _CHAT, "op13_source_divergence": _DIVERGENCE}
