"""One query for each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The installed public vocabulary's place, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdedup import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, held_out, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.withColumn("held_out", held_out()), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .batches import new_table
    from .idcoder import digest_token_ids, write_token_ids

    path = new_table(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, vocabulary())
    return digest_token_ids(spark, path)


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_mixture

    return pack_mixture(table(spark, sf_dir, "documents"), vocabulary())


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by the checksum of conversation and turn; nulls count as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(told("role"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged_conversations(rows), every=rows)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by their id's checksum, go on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    # an array of their own, or each use would take the text apart again
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.col("g"), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return split.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import detect_runs

    return detect_runs(with_repeated_tails(table(spark, sf_dir, "documents")), with_text=False)


def repair_sql() -> str:
    """The repair as a recursion over each conversation's rows that carries the best script to each of the four states."""
    step = lambda cell, cost, letter, line: f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letter}', 't': {cell}.t || {line}}}"
    least = lambda *cells: f"list_min([{', '.join(cells)}])"
    never = "{'c': 1000000000, 'a': '', 't': ''}"

    def edited(cell: str, role: str) -> str:
        """A row kept, or with another role, after the state ``cell``."""
        new = {"s": None, "u": "user", "a": "assistant"}[role]
        kept = step(cell, "k.more", "K", "k.line")
        other = never if new is None else step(cell, "2 + k.more", "R", f"chr(10) || '{new}:' || k.text")
        return f"CASE WHEN k.fault IN (1, 2) THEN {never} WHEN k.initial = '{role}' THEN {kept} ELSE {other} END"

    deleted = lambda cell: step(cell, 3, "D", "''")
    inserted = lambda cell, role: step(cell, 2, "I", f"chr(10) || '{role}:'")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    told = "coalesce({}::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, {told.format("role")} AS role, {told.format("text")} AS text, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split({told.format("conv_id")} || ':' || {told.format("turn")}, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
  ), 4294967295::UBIGINT) % 20 AS f FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) r(again) WHERE f <> 0 AND (again = 0 OR f = 3)),
p AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {white}) AS bare FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
k AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS more, chr(10) || role || ':' || text AS line,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n),
walk(conv_id, i, o, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, {never}, {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, o, s, u, {least("x", inserted("u", "assistant"))} FROM (
    SELECT conv_id, i, o, s, x, {least("y", inserted("o", "user"), inserted("s", "user"), inserted("x", "user"))} AS u FROM (
      SELECT w.conv_id, k.i, {deleted("w.o")} AS o, {least(deleted("w.s"), edited("w.o", "s"))} AS s,
        {least(deleted("w.a"), edited("w.u", "a"))} AS x,
        {least(deleted("w.u"), edited("w.o", "u"), edited("w.s", "u"), edited("w.a", "u"))} AS y
      FROM walk w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1))),
done AS (SELECT conv_id, {least("o", "a")} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM done LEFT JOIN counts ON done.conv_id IS NOT DISTINCT FROM counts.conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_bpe": op4_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_id_files": op10_token_id_files,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
WHERE rank <= 5""",
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT doc_id, text, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS tokens FROM l),
m AS (
  SELECT doc_id, text, line, tokens, list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked FROM t WHERE len(tokens) > 0),
k AS (
  SELECT *, len(tokens) || ' ' || array_to_string(masked[1:3], ' ') AS leaf FROM m),
leaves AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT text) >= 5),
kept AS (
  SELECT doc_id, text, line, leaf,
    array_to_string(CASE WHEN len(list_filter(masked, lambda t: t = '<*>')) <= 0.2::DOUBLE * len(masked) THEN masked ELSE tokens END, ' ') AS masked
  FROM k WHERE leaf IN (SELECT leaf FROM leaves)),
lines AS (SELECT leaf, masked, count(DISTINCT text) AS texts FROM kept GROUP BY ALL),
places AS (
  SELECT leaf, masked, texts, unnest(string_split(masked, ' ')) AS token, generate_subscripts(string_split(masked, ' '), 1) - 1 AS pos FROM lines),
constant AS (SELECT leaf, pos, token FROM places WHERE pos >= 3 GROUP BY ALL HAVING sum(texts) >= 5),
general AS (
  SELECT p.leaf, p.masked, list(CASE WHEN p.pos >= 3 AND c.token IS NULL THEN '<*>' ELSE p.token END ORDER BY p.pos) AS template
  FROM places p LEFT JOIN constant c ON p.leaf = c.leaf AND p.pos = c.pos AND p.token = c.token WHERE p.texts < 5 GROUP BY ALL),
named AS (
  SELECT k.doc_id, k.text, k.line, coalesce(array_to_string(g.template, ' '), k.masked) AS template
  FROM kept k LEFT JOIN general g ON k.leaf = g.leaf AND k.masked = g.masked AND len(list_filter(g.template, lambda t: t = '<*>')) <= 0.2::DOUBLE * len(g.template)),
recurring AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING count(DISTINCT text) >= 5),
drops AS (
  SELECT n.doc_id, list(DISTINCT n.line) AS gone FROM named n JOIN recurring r USING (template) WHERE n.doc_id IS DISTINCT FROM r.first GROUP BY n.doc_id)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL OR x.gone IS NULL THEN d.text
    ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda l: NOT list_contains(x.gone, l)), chr(10)) END AS text,
  CASE WHEN d.text <> '' THEN len(string_split(d.text, chr(10))) ELSE 0 END::BIGINT AS n_lines,
  CASE WHEN d.text <> '' AND x.gone IS NOT NULL THEN len(list_filter(string_split(d.text, chr(10)), lambda l: list_contains(x.gone, l))) ELSE 0 END::BIGINT AS n_dropped
FROM documents d LEFT JOIN drops x ON d.doc_id IS NOT DISTINCT FROM x.doc_id""",
    "op3_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, pos) FROM l WHERE level <= ratio) * weight) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':42'), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m""",
    "op12_conversation_repair": repair_sql(),
}
