"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import chat, html_text, jaccard, line_dedup, packing, pii, piece_bpe, quality, secret_scan, topk
from sieveworks.llm._common import table


def public_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_lines_gone").cast("long").alias("n_gone"), F.col("_near_gone").cast("long").alias("n_near"), F.sha2("text", 256).alias("text_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_file("piece_bpe_32k.model")
    coded = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", *quality.MEASURES[:5], (F.col("failed_bits").bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"),
        quality.passes().alias("kept"), "failed_bits",
    )


def _listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _kinds(spans: str, kinds: tuple[str, ...]) -> list:
    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return [of(kind).alias(f"n_{kind}") for kind in kinds]


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_kinds("base_spans", pii.KINDS[:4]), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_kinds("base_spans", secret_scan.KINDS[:3]), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(chat.events_of(rows))
    read = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_line_dedup, op4_ngram_jaccard, op5_sentencepiece, op6_personal_data, op7_secrets, op8_main_text, op9_top_k,
        op10_chat_formatting,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LINE_WORD = r"'[^\x20\x09-\x0D]'"

_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_LINE_WORD}) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
      FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * word_chars < 5 * n_words THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END
             + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_upper_words > 50 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_bangs > 60 * n_words THEN 128 ELSE 0 END AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept,
       CAST(failed_bits AS INTEGER) AS failed_bits FROM b
"""

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace({}, '~', '~0'), '<|', '~1'), '</s>', '~2'), '<s>', '~3'), '[/INST]', '~4'), '[INST]', '~5'), '|>', '~6')"
_OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 12) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: Distinct lines of five words or more with their first place; every deletion and gap of each; the earliest line of each of these.
_OP3 = """
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, pos, ls[pos] AS line, string_split(ls[pos], ' ') AS w, CAST(doc_id AS HUGEINT) * 2147483648 + pos AS place
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM a)),
c AS (SELECT * FROM l WHERE len(w) >= 5),
u AS (SELECT line, any_value(w) AS w, min(place) AS place FROM c GROUP BY line),
k AS (SELECT line, place, FALSE AS gap, md5(array_to_string(w[:i - 1], ' ') || chr(31) || array_to_string(w[i + 1:], ' ')) AS key
      FROM (SELECT line, place, w, unnest(range(1, len(w) + 1)) AS i FROM u)
      UNION ALL
      SELECT line, place, TRUE, md5(array_to_string(w[:i], ' ') || chr(31) || array_to_string(w[i + 1:], ' '))
      FROM (SELECT line, place, w, unnest(range(0, len(w) + 1)) AS i FROM u)),
m AS (SELECT key, min(place) FILTER (NOT gap) AS d, min(place) FILTER (gap) AS g FROM k GROUP BY key),
n AS (SELECT DISTINCT k.line FROM k JOIN m USING (key) WHERE m.d < k.place OR (NOT k.gap AND m.g < k.place)),
f AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.place > u.place, FALSE) AS equal, n.line IS NOT NULL AS near
      FROM l LEFT JOIN u ON l.line = u.line LEFT JOIN n ON l.line = n.line),
t AS (SELECT doc_id, count(*) FILTER (equal OR near) AS n_gone, count(*) FILTER (near AND NOT equal) AS n_near,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT equal AND NOT near), '') AS text FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_gone, 0) AS n_gone, coalesce(n_near, 0) AS n_near, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE t.text END) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

ORACLE_SQL = {"op3_line_dedup": _OP3, "op4_ngram_jaccard": _OP4, "op9_top_k": _OP9, "op2_quality_rules": _OP2, "op10_chat_formatting": _OP10}
