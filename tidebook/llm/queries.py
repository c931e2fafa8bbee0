"""The queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fim, language_model, packing, pii, quality, simhash, sketch, substrings, toxicity, urls, whitening
from .tables import configure, fold, table


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    configure(spark)
    documents = table(spark, sf_dir, "documents")
    ranking = quality.fit(documents, table(spark, sf_dir, "labels"), folds=5, left_out=0)
    scored = quality.score(documents, ranking, cut=0.3)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and the surrogates' places as text."""
    configure(spark)
    done = pii.rewritten(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return done.select("row.doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.to_json("entities").alias("entities"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    configure(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    configure(spark)
    done = substrings.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    configure(spark)
    return packing.pack(packing.tokenized(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    configure(spark)
    documents = table(spark, sf_dir, "documents")
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"), folds=3, left_out=1)
    scored = toxicity.score(documents, net, cut=0.7)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    configure(spark)
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    configure(spark)
    found = sketch.against_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch"), F.col("sketch_least")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch"), F.col("edited_sketch_least")).alias("edited_fingerprint"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch"), F.col("sketch_least"), F.col("edited_sketch_least")).alias("near_edited"),
        F.coalesce(sketch.containment(F.col("sketch"), F.col("next_sketch"), F.col("sketch_least"), F.col("next_sketch_least")), F.lit(0.0)).alias("near_next"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits a byte."""
    configure(spark)
    scored = language_model.score(table(spark, sf_dir, "documents"), folds=5, left_out=1)
    held = (fold(F.col("doc_id"), 5) == 1).alias("held_out")
    rate = (-F.col("score") * F.lit(3.321928094887362) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", rate)


URL_RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    configure(spark)
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    configure(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, state, first_bad."""
    configure(spark)
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.formatted(rows).withColumn("formatted", chat.joined(F.col("segments"))).withColumn("loss", chat.loss_text(F.col("segments")))
    done = done.withColumn("turns", chat.turns_of(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "first_bad",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    configure(spark)
    done = fim.transform(table(spark, sf_dir, "documents"))
    rebuilt = fim.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(rebuilt).alias("restored_sha256"))


QUERIES = {
    "op11_whitening": op11_whitening,
    "op12_chat": op12_chat,
    "op13_fill_in_middle": op13_fill_in_middle,
    "op9_language_model": op9_language_model,
    "op8_sketch": op8_sketch,
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op12_chat": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS s FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### [' || coalesce(upper(hex(role)), '-') || ']: ' END AS mark,
  regexp_replace(s, '(### System: |### User: |### Assistant: |### \[|</turn>)', '\\\1', 'g') AS held,
  CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || s || chr(10), '' ORDER BY turn, role, held) AS spoken,
  coalesce(string_agg(s, '' ORDER BY turn, role, held) FILTER (role = 'assistant'), '') AS loss, sum(length(mark) + length(held) + 9) AS chars,
  string_agg(letter, '' ORDER BY turn, role, held) AS letters FROM marked GROUP BY conv_id),
m AS (SELECT *, length(regexp_extract(letters, '^s?(ua)*u?')) AS fine FROM c)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  CASE WHEN fine < n_turns THEN 'broken' WHEN letters LIKE '%u' THEN 'asked' WHEN letters LIKE '%a' THEN 'answered' ELSE 'ready' END AS state,
  CASE WHEN fine < n_turns THEN CAST(fine AS BIGINT) END AS first_bad
FROM m""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
f AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM f""",
    "op4_substrings": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
again AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, q FROM again, unnest(range(p, p + 20)) AS t(q)),
word AS (SELECT doc_id, q, w[q] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS s FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op7_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(p)),
hit AS (SELECT DISTINCT doc_id, p, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
}
