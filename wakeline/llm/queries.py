"""The registered queries of this subpackage, each over its whole table, and their statements as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import (
    chat,
    decontaminate,
    hard_negatives,
    language,
    licenses,
    line_chunks,
    mixing,
    near_text,
    near_vectors,
    packing,
    passages,
    periodic_runs,
    urls,
)
from wakeline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark, sf):
    found = line_chunks.remove_repeated_chunks(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(language.training_sample(docs, "doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_words")


def op3_embedding_near_dedup(spark, sf):
    return near_vectors.near_duplicates(table(spark, sf, "embeddings"))


def op4_license_scan(spark, sf):
    found = licenses.scan(table(spark, sf, "documents"), licenses.known_digests(spark))
    return found.select("doc_id", "license", "n_notices", F.array_join("licenses", ",").alias("licenses"))


def op5_url_filter(spark, sf):
    """The list's own verdicts on pages are the labelled URLs that the classifier learns the other verdicts from."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    by_rule = urls.judge(pages, None, urls.RULES).where("rule IS NOT NULL")
    model = urls.train(by_rule.select("url", F.col("verdict").alias("label")))
    found = urls.judge(pages, model, urls.RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_minhash_near_dedup(spark, sf):
    return near_text.near_duplicates(table(spark, sf, "documents")).drop("text_hash")


PROBE = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark, sf):
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    # Null fields are written too, so that every row has the same field paths.
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    turns = chat.canonical_turns(rows.select("conv_id", record.alias("record")), "conv_id", "record")
    return chat.conversation_digests(chat.formatted_turns(turns))


def op8_benchmark_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_packing(spark, sf):
    import public_tokenizers

    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return packed.select(*columns)


def op10_suffix_array_dedup(spark, sf):
    found = passages.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label)


def with_repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by hash repeats a stretch of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10")).alias("g"))
    words = F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w"))
    begin = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", begin).withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    at = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
    place = F.transform(at, lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.transform(place, lambda i: F.get("w", i.cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf):
    found = periodic_runs.detect(with_repetition(table(spark, sf, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_mixing(spark, sf):
    found = mixing.mix(table(spark, sf, "documents")).taken()
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def registered() -> dict[str, Query]:
    found = [op1_line_dedup, op2_language_id, op3_embedding_near_dedup, op4_license_scan, op5_url_filter, op6_minhash_near_dedup, op7_chat_formatting, op8_benchmark_decontamination, op9_packing, op10_suffix_array_dedup, op11_hard_negatives, op12_periodic_runs, op13_source_mixing]
    return {f.__name__: f for f in found}


# Words of a text, as the decontamination query takes them.
_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP8 = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
    SELECT DISTINCT item, list_slice(w, s, s + 9) AS win, least(len(w), 10) AS size
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
piece AS (
    SELECT doc_id, s, size, list_slice(w, s, s + size - 1) AS win
    FROM (
        SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS s
        FROM doc, (SELECT DISTINCT size FROM win)
    )
),
hit AS (SELECT DISTINCT doc_id, s, piece.size AS size, item FROM piece JOIN win USING (win)),
hit_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP1 = """
WITH doc AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
line AS (
    SELECT doc_id, i, len(lines) AS n, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc)
),
roll AS (SELECT *, coalesce(lag(h) OVER by_doc, 0) * 31 + h AS r FROM line WINDOW by_doc AS (PARTITION BY doc_id ORDER BY i)),
mark AS (
    SELECT *, i = n OR coalesce(r < lag(r) OVER by_doc AND r <= lead(r) OVER by_doc, false) AS is_end
    FROM roll WINDOW by_doc AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT *, sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i) - is_end::INT AS chunk_no FROM mark
),
chunk AS (
    SELECT doc_id, chunk_no, min(i) AS first, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS chunk
    FROM numbered GROUP BY doc_id, chunk_no
),
pair AS (
    SELECT doc_id, i AS first, line || chr(10) || lead(line) OVER by_doc AS chunk
    FROM line WINDOW by_doc AS (PARTITION BY doc_id ORDER BY i) QUALIFY i < n
),
gone AS (
    SELECT whole, doc_id, first, size
    FROM (
        SELECT *, row_number() OVER (PARTITION BY whole, chunk ORDER BY doc_id NULLS FIRST, first) AS copy
        FROM (SELECT true AS whole, doc_id, first, size, chunk FROM chunk UNION ALL SELECT false, doc_id, first, 2, chunk FROM pair)
        WHERE size >= 2 AND regexp_matches(chunk, '[^\\x20\\x09-\\x0D]')
    )
    WHERE copy > 1
),
gone_line AS (SELECT DISTINCT doc_id, unnest(range(first, first + size)) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM line ANTI JOIN gone_line USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n_removed FROM gone_line GROUP BY doc_id),
total_chunks AS (SELECT doc_id, count(*) AS n_chunks_removed FROM gone WHERE whole GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_chunks_removed, 0) AS n_chunks_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM doc LEFT JOIN total USING (doc_id) LEFT JOIN total_chunks USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


# Vectors that can link, their pairs, and components by repeated minima.
OP3 = """
WITH RECURSIVE vec AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vec a, vec b
    WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN component USING (vec_id)
"""

OP6 = """
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL
),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y USING (g)
    WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
link AS (
    SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * pair.n >= 85 * (p.n + q.n - pair.n)
),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN component USING (doc_id)
"""


OP7 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
    SELECT *, length(regexp_replace(role, '(\\|### |</turn>|:|\n)', '\\\1', 'g')) AS role_size,
              length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) AS text_size
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + role_size + text_size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _op4() -> str:
    """Made from the operator's fixed values; the rules are written out again."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    unified = "lower(line)"
    for spelling, other in licenses.SPELLINGS:
        unified = f"replace({unified}, {quoted(spelling)}, {quoted(other)})"
    known = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(licenses.NOTICES + licenses.TEXTS))
    return f"""
WITH known(k, license, text) AS (VALUES {known}),
unit AS (
    SELECT 'known' AS kind, k::BIGINT AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM known
    UNION ALL
    SELECT 'doc', doc_id, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM documents
),
canon AS (
    SELECT kind, id, i, trim(regexp_replace({unified}, '[^a-z0-9]+', ' ', 'g')) AS c
    FROM unit WHERE NOT regexp_matches(lower(line), '^\\W*(copyright\\b|\\(c\\)|©|all rights reserved\\b)')
),
whole AS (SELECT kind, id, string_agg(c, ' ' ORDER BY i) AS c FROM canon WHERE c <> '' GROUP BY kind, id),
digest AS (SELECT c, min(license) AS license FROM whole JOIN known ON k = id WHERE kind = 'known' GROUP BY c),
found AS (
    SELECT id, 0 AS is_whole, license FROM canon JOIN digest USING (c) WHERE kind = 'doc'
    UNION ALL
    SELECT id, 1, license FROM whole JOIN digest USING (c) WHERE kind = 'doc'
),
per_doc AS (
    SELECT id, min(license) FILTER (is_whole = 1) AS license, sum(1 - is_whole)::BIGINT AS n_notices,
           string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
    FROM found GROUP BY id
)
SELECT doc_id, license, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN per_doc ON id = doc_id
"""


OP11 = """
WITH vec AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
score AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM vec a JOIN vec b ON a.id <> b.id WHERE a.id % 100 = 0
),
positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM score WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER best AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN score s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER best <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1,
        "op3_embedding_near_dedup": OP3,
        "op4_license_scan": _op4(),
        "op6_minhash_near_dedup": OP6,
        "op7_chat_formatting": OP7,
        "op8_benchmark_decontamination": OP8,
        "op11_hard_negatives": OP11,
    }
