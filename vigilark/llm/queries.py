"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm import (byte_bpe, chat, collocations, language, licenses, lm, nearest, neardup, packing, pages, quality,
                          secret_scan, whitening)
from vigilark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, ranks, pattern, decoded=True, keep_text=False).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.learn(*quality.labelled(docs, table(spark, folder, "labels")))
    found = quality.judged(docs, rules)
    return found.select("doc_id", *(F.col(f"{quality.COLUMN}.{n}") for n in quality.STATISTICS[:5]),
                        "base_failed", "kept")


@query
def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
              for kind, *_ in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written_spans(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.written_spans(F.col("spans")).alias("spans"))


@query
def op7_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    marks = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    formatted = chat.windows(turns)
    back = chat.read_back(formatted).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text", "loss_text"))).alias("turns"))
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    return back.join(sizes.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query
def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents"))


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.is_held_out().alias("held_out"), F.col("language.pred").alias("lang_pred"), "language.score")


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_texts(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), lm.Settings(public_tokenizers.path("word_bpe_49k.json")))


@query
def op11_whiten(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"), components=16)


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


@query
def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.labelled(licenses.scan(table(spark, folder, "documents").select("doc_id", "text")))


ORACLES["op6_near_duplicates"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON doc_id = id"""

ORACLES["op7_chat_windows"] = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
counted AS (SELECT *, ceil(length(text) / 4.0)::BIGINT + 4 AS tokens, row_number() OVER w - 1 AS position FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  max(tokens) OVER (PARTITION BY conv_id) AS longest,
  position = coalesce(min(CASE WHEN role = 'system' THEN position END) OVER (PARTITION BY conv_id), -1) AS is_system FROM counted),
slotted AS (SELECT *, floor(before / greatest(1024 - 256 - coalesce(max(CASE WHEN is_system THEN tokens END) OVER (PARTITION BY conv_id), 0)
  - longest + 1, 1)) AS slot FROM placed),
windowed AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY slot) AS win,
  max(before + tokens) OVER (PARTITION BY conv_id, slot) AS slot_end FROM slotted),
copied AS (SELECT *, 1 + CASE WHEN is_system THEN max(win) OVER (PARTITION BY conv_id) - win
  WHEN win < max(win) OVER (PARTITION BY conv_id) AND slot_end - before <= 256 THEN 1 ELSE 0 END AS copies FROM windowed),
sized AS (SELECT *, length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10)
  || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) AS size FROM copied)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size * copies)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
   FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scores AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.cut, (1000 * c.a * t.n) // (x.f * y.f) AS score
   FROM cuts c JOIN totals t ON t.lang = c.lang
   JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
   JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
   FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cuts WHERE cut = 1)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
   a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000"""


def _license_twin() -> str:
    """Every block against every template, by their words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, {quoted(phrase)})" for label, phrase in licenses.PHRASES)
    low = lambda t: f"translate({t}, '{licenses.UPPER}', '{licenses.LOWER}')"
    words = lambda t: rf"list_filter(regexp_split_to_array({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, {low("coalesce(text, '')")} AS low FROM documents),
docs AS (SELECT *, {words("low")} AS w FROM texts),
templates AS (SELECT template, label, list_distinct({words(low("t"))}) AS w FROM (VALUES {templates}) v(template, label, t)),
blocks AS (SELECT row_id, unnest(b) AS block_text, unnest(range(len(b))) AS block
  FROM (SELECT row_id, regexp_split_to_array(low, '[.!?][\x09-\x0D\x20]+|\n[\x09\x20]*\n') AS b FROM texts)),
tokens AS (SELECT row_id, block, unnest(list_distinct({words("block_text")})) AS word FROM blocks),
shared AS (SELECT row_id, block, template, label, len(any_value(w)) AS size, count(*) AS overlap
  FROM tokens JOIN (SELECT *, unnest(w) AS word FROM templates) USING (word) GROUP BY ALL
  HAVING 100 * count(*) >= {licenses.PERCENT} * len(any_value(w))),
best AS (SELECT row_id, label, overlap / size AS containment FROM shared
  QUALIFY rank() OVER (PARTITION BY row_id, block ORDER BY overlap / size DESC, overlap DESC) = 1),
base AS (SELECT row_id, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(p)) = p)) AS place
  FROM docs, (SELECT label, string_split(t, ' ') AS p FROM (VALUES {phrases}) v(label, t))),
labels AS (SELECT row_id, label, true AS is_base FROM base UNION SELECT row_id, label, false FROM best),
named AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM labels GROUP BY row_id),
counts AS (SELECT row_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM base GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN counts USING (row_id) LEFT JOIN named USING (row_id)
LEFT JOIN (SELECT row_id, max(containment) AS c FROM best GROUP BY row_id) USING (row_id)"""


ORACLES["op13_licenses"] = _license_twin()
