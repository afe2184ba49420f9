"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted_trees, chat_windows, fingerprint_index, interleave, license_templates, mtree, piece_offsets, simhash, vector_packing, weak_rules

ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(_table(spark, sf_dir, "embeddings"), every=50, k=5)


ORACLE["op1_mtree_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), tokens=1024)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return boosted_trees.score(docs, boosted_trees.train(docs, _table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_index.dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("`in.doc_id`").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM again, range(0, 20) r(j)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_windows.read_back(chat_windows.windows(rows.unionByName(more)))


# One turn after the other as in the operator: the tokens of a rendered line decide the windows, and only the number of characters shows in the result.
_TOKENS = chat_windows.TOKEN.replace("'", "''")
_ESCAPED = "replace(replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLE["op5_chat_windows"] = f"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(c, turn, role, text)
),
line AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    '<|im_start|>' || {_ESCAPED.format("role")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS line
  FROM said
),
counted AS (SELECT *, len(regexp_extract_all(line, '{_TOKENS}')) AS tokens, length(line) AS size, i = 0 AND role = 'system' AS leads FROM line),
led AS (SELECT *, CASE WHEN leads THEN 0 ELSE tokens END AS body, sum(CASE WHEN leads THEN tokens ELSE 0 END) OVER (PARTITION BY c)::BIGINT AS head FROM counted),
summed AS (SELECT *, greatest(2048 - head, 2) AS room, (sum(body) OVER (PARTITION BY c ORDER BY i) - body)::BIGINT AS before FROM led),
stepped AS (SELECT *, before // (room // 2) AS step, body > room // 2 AS large FROM summed),
turned AS (
  SELECT *, (i > 0 AND NOT lag(leads, 1, false) OVER o AND (step <> lag(step) OVER o OR large OR lag(large) OVER o))::INT AS turned FROM stepped WINDOW o AS (PARTITION BY c ORDER BY i)
),
placed AS (SELECT *, sum(turned) OVER (PARTITION BY c ORDER BY i)::BIGINT AS w FROM turned),
win AS (SELECT c, w, min(i) AS begin, min(before) AS start, sum(body)::BIGINT AS spent, max(room) AS room, sum(size)::BIGINT AS size FROM placed GROUP BY c, w),
past AS (
  SELECT win.c, win.w, sum(p.size)::BIGINT AS size FROM win JOIN placed p ON win.c IS NOT DISTINCT FROM p.c AND p.i BETWEEN win.begin - 4 AND win.begin - 1 AND NOT p.leads AND win.start - p.before <= win.room - win.spent
  GROUP BY win.c, win.w
),
lead_line AS (SELECT c, size FROM placed WHERE leads),
long AS (
  SELECT win.c, sum(win.size + coalesce(past.size, 0) + CASE WHEN win.w > 0 THEN coalesce(lead_line.size, 0) ELSE 0 END + {len(chat_windows.NEW)})::BIGINT AS formatted_chars
  FROM win LEFT JOIN past ON win.c IS NOT DISTINCT FROM past.c AND win.w = past.w LEFT JOIN lead_line ON win.c IS NOT DISTINCT FROM lead_line.c GROUP BY win.c
),
whole AS (
  SELECT c, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS learnt FROM placed GROUP BY c
)
SELECT whole.c AS conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM whole JOIN long ON whole.c IS NOT DISTINCT FROM long.c
"""


def op6_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_offsets.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, segments=2, radius=2, similarity=None)


def op8_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interleave.interleave(_table(spark, sf_dir, "documents"), shards=16)
    return found.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.label(_table(spark, sf_dir, "documents"))


ORACLE["op9_license_templates"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS res
  FROM w
),
l AS (
  SELECT *, list_concat(cc, list_concat(gpl, res)) AS a,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    list_filter([
      CASE WHEN regexp_matches(t, ' licensed under the (terms of the )?apache license (version )?2 0 ') THEN 'apache-2.0' END,
      CASE WHEN contains(t, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd' END,
      CASE WHEN regexp_matches(t, ' licensed under (a )?cc by 4 0 ') THEN 'cc-by-4.0' END,
      CASE WHEN regexp_matches(t, ' licensed under (a )?cc by nc 4 0 ') THEN 'cc-by-nc-4.0' END,
      CASE WHEN regexp_matches(t, ' licensed under (a )?cc by sa 4 0 ') THEN 'cc-by-sa-4.0' END,
      CASE WHEN regexp_matches(t, ' copyright (c )?([^ ]+ ){1,8}all rights reserved ') THEN 'copyright-notice' END,
      CASE WHEN regexp_matches(t, ' (licensed|released|distributed) under the (terms of the )?gnu general public license (as published by the free software foundation either )?version 3 ') THEN 'gpl-3.0' END,
      CASE WHEN regexp_matches(t, ' (licensed|released|distributed) under the (terms of the )?mit license ') THEN 'mit' END,
      CASE WHEN regexp_matches(t, ' permission is hereby granted free of charge to any person obtaining a copy of this ([^ ]+ ){1,2}and associated documentation files ') THEN 'mit-notice' END
    ], lambda x: x IS NOT NULL) AS more
  FROM p
)
SELECT doc_id, n_words::BIGINT AS n_words, len(a)::BIGINT AS n_base, (list_min(a) - 1)::BIGINT AS first_word, (list_max(a) - 1)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_concat(base, more)), ',') AS labels,
  (CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM l
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mtree_search, op2_vector_packing, op3_quality_classifier, op4_substring_dedup, op5_chat_windows, op6_piece_offsets, op7_simhash, op8_interleave, op9_license_templates, op10_quality_rules)
}
