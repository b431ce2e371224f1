"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import ann, byte_bpe, chat, exact_dedup, licenses, merkle, minhash_dedup, packing, pii, runs, suffix_dedup, token_store, toxicity
from revspark.llm.common import read_table, shared_path


#: The conversation that op1 adds: control strings as ordinary text.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
#: Key of the registered PII query unless the session names one in PII_KEY_CONF.
PII_KEY_CONF, PII_KEY = "revspark.pii.key", "example key, to be replaced"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_trees(chat.linear(table.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.templates(spark))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, docs, read_table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, pattern)
    both = byte_bpe.decode_documents(encoded, path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, spark.conf.get(PII_KEY_CONF, PII_KEY))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), "pii")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    kept = F.length("kept")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(read_table(spark, sf_dir, "documents"), runs.planted_order)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("length * 1000 div period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.checksums(spark, path)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    out = merkle.verify(merkle.manifest(read_table(spark, sf_dir, "documents"), tampered))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_nearest": op10_nearest,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_store": op12_token_store,
    "op13_merkle": op13_merkle,
}


def op3_sql() -> str:
    """Every window against every template, without MinHash."""
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({k}, {q(name)}, {q(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    classes = " ".join(f"WHEN len(t) = {n} THEN {licenses.length_class(n)}" for n in range(1, 200))
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    shingles = ("CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) "
                "WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END")
    return f"""
        WITH tp(tid, license_id, text) AS (VALUES {values}),
             ts AS (SELECT tid, license_id, list_distinct({shingles}) AS t FROM (SELECT tid, license_id, {words} AS ws FROM tp)),
             tc AS (SELECT *, CASE {classes} END AS c FROM ts),
             ds AS (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words} AS ws FROM documents)),
             h AS (SELECT doc_id, s, license_id, t, c, unnest(range(0, len(s), greatest(1, c // 2))) AS pos
                   FROM ds JOIN tc ON list_has_any(s, t)),
             m AS (SELECT doc_id, license_id, c, pos, max(len(list_intersect(t, s[pos + 1:pos + ceil(1.5 * c)::BIGINT])) / len(t)) AS share
                   FROM h GROUP BY ALL)
        SELECT doc_id, license_id, max(share) AS containment, min(pos)::INT AS first_word, count(*) AS n_windows
        FROM m WHERE share >= {licenses.SHARE} GROUP BY ALL"""


def op13_sql() -> str:
    """Level by level over (group, level, position): parents, then siblings of every ancestor; crc32 has no SQL function, so it is a table-driven fold."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    # crc32 of the decimal digits: one byte at a time, eight shifts each.
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    shifts = "c"
    for _ in range(8):
        shifts = f"list_transform([{shifts}], lambda c: {step})[1]"
    byte = shifts.replace("[c]", "[xor(a, ascii(b)::BIGINT)]", 1)
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, b: {byte.replace('ascii(b)::BIGINT', 'b')}), 4294967295)"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS own FROM documents),
             l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
             t AS (SELECT lang, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM l
                   UNION ALL
                   SELECT lang, lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 8),
             s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
             u AS (SELECT 0 AS lvl, pos, subroot AS node, count(*) OVER () AS n FROM s
                   UNION ALL
                   SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, pos // 8),
             h AS (SELECT max(lvl) AS height FROM u),
             k AS (SELECT l.lang, max(lvl) AS depth FROM t JOIN l ON l.lang IS NOT DISTINCT FROM t.lang AND l.pos = 0 GROUP BY l.lang),
             a AS (SELECT l.doc_id, l.leaf, l.own, l.lang, l.pos AS lpos, g.lvl AS step, g.pos AS p, g.node,
                          CASE WHEN g.pos < l.pos // (8 ** g.lvl)::BIGINT THEN 0 ELSE 1 END AS side
                   FROM l JOIN t g ON g.lang IS NOT DISTINCT FROM l.lang AND g.pos // 8 = l.pos // (8 ** (g.lvl + 1))::BIGINT AND g.pos <> l.pos // (8 ** g.lvl)::BIGINT
                   UNION ALL
                   SELECT l.doc_id, l.leaf, l.own, l.lang, l.pos, k.depth + g.lvl, g.pos, g.node, CASE WHEN g.pos < s.pos // (8 ** g.lvl)::BIGINT THEN 0 ELSE 1 END
                   FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN k ON k.lang IS NOT DISTINCT FROM l.lang
                          JOIN u g ON g.pos // 8 = s.pos // (8 ** (g.lvl + 1))::BIGINT AND g.pos <> s.pos // (8 ** g.lvl)::BIGINT),
             b AS (SELECT lang, lpos, step, coalesce(string_agg(node, '' ORDER BY p) FILTER (side = 0), '') AS lft, coalesce(string_agg(node, '' ORDER BY p) FILTER (side = 1), '') AS rgt
                   FROM a GROUP BY ALL),
             steps AS (SELECT l.lang, l.pos AS lpos, l.doc_id, l.leaf, l.own, coalesce(list(struct_pack(step := y.step, l := coalesce(b.lft, ''), r := coalesce(b.rgt, '')) ORDER BY y.step) FILTER (y.step IS NOT NULL), []) AS sides
                       FROM l JOIN k ON k.lang IS NOT DISTINCT FROM l.lang CROSS JOIN h
                       LEFT JOIN (SELECT unnest(range(0, 64)) AS step) y ON y.step < k.depth + h.height
                       LEFT JOIN b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lpos = l.pos AND b.step = y.step GROUP BY ALL),
             f AS (SELECT *, list_reduce(list_prepend(own, list_transform(sides, lambda x: x.l || '|' || x.r)),
                             lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root FROM steps),
             r AS (SELECT node AS root FROM u WHERE n = 1)
        SELECT doc_id, leaf, s.subroot, r.root, sha256(array_to_string(list_transform(sides, lambda x: x.l || x.r), '')) AS proof_sha256,
               folded_root, folded_root = r.root AS verified
        FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang CROSS JOIN r"""


ORACLE_SQL: dict[str, str] = {
    "op13_merkle": op13_sql(),
    "op3_licenses": op3_sql(),
    "op1_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
             n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
             e AS (SELECT *, list_reduce(list_prepend(replace(text, chr(9243), chr(9243) || '0'),
                          ['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<|startoftext|>', '<|system|>', '<|user|>', '<|assistant|>', '<|eot_id|>',
                           '<|start_header_id|>', '<|end_header_id|>', '<|begin_of_text|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']),
                          lambda x, y: replace(x, y, y[1] || chr(9243) || '1' || y[2:])) AS esc FROM n)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(esc) + 24)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-c, doc_id)) AS keep_id FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
    "op10_nearest": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
