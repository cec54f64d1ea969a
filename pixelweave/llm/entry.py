"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontaminate, exact_dedup, licences, mixing, near_dedup, pieces, pii, prefix_trie, quality, repeats, secrets, spelling
from .common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)), ("assign", "access", "hex"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc.doc_id", "quality_text", "quality_meta", "quality", (F.col("quality") >= 0.5).alias("kept"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(pii.scan_pii(documents(spark, sf_dir)), pii.KINDS)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan_licences(documents(spark, sf_dir).select("doc_id", "text")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_remove_repeats": op4_remove_repeats,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mix_sources": op6_mix_sources,
    "op7_licences": op7_licences,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_audio_features": op9_audio_features,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontaminate": op12_decontaminate,
    "op13_spelling_groups": op13_spelling_groups,
}

#: The CRC-32 table of the sixteen half bytes.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half byte by half byte."""
    halves = f"list_transform(range(2 * strlen({text})), lambda k: CAST(strpos('0123456789ABCDEF', substr(hex({text}), CAST(k // 2 * 2 + 2 - k % 2 AS BIGINT), 1)) - 1 AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {halves}), lambda c, b: xor(c >> 4, {_CRC}[(xor(c, b) & 15) + 1])))"


ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS own, {_crc32_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM t GROUP BY c),
        whole AS (SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS seq FROM s a LEFT JOIN s b ON b.c = a.c - a.c % 5),
        pre AS (SELECT c, d, len(seq) = d AS ends, seq[1:d] AS pre FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM whole)),
        node AS (
          SELECT d, pre, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends,
                 (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(pre)[d].x) END AS saved FROM pre GROUP BY d, pre),
        child AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
        told AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN child ON node.d = child.d AND node.pre = child.pre),
        up AS (SELECT pre[1:a] AS pre, a AS d, saved, k FROM (SELECT *, unnest(range(d + 1)) AS a FROM told)),
        below AS (SELECT d, pre, sum(saved) AS saved, count(*) FILTER (k = 0) AS leaves FROM up GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.k AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM told n JOIN below b ON n.d = b.d AND n.pre = b.pre LEFT JOIN node p ON p.d = n.d - 1 AND p.pre = n.pre[1:n.d - 1]""",
    "op12_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM sized)),
        dw AS (
          SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw))),
        met AS (SELECT doc_id, m, s, item_id FROM dw JOIN bw USING (m, win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, m, s FROM met)) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op13_spelling_groups": rf"""
        WITH RECURSIVE runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
        per AS (SELECT id || ':' || w AS key, w, count(*) AS n FROM runs GROUP BY ALL),
        h AS (SELECT w, n, {_crc32_sql("key")} AS h FROM per),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
        holes AS (SELECT DISTINCT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS mask, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
        near AS (
          SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (mask) WHERE a.word <> b.word
          UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN v b ON a.short = b.word
          UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN v b ON a.short = b.word),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS nth FROM near),
        told AS (
          SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * v.n THEN r.other END AS form, CASE WHEN r.m >= 2 * v.n THEN r.m END AS form_n
          FROM v LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) r USING (word)),
        chain AS (SELECT word, word AS at, form AS next FROM told UNION ALL SELECT chain.word, told.word, told.form FROM chain JOIN told ON chain.next = told.word)
        SELECT told.word, told.form, chain.at AS root, told.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM told JOIN chain ON told.word = chain.word AND chain.next IS NULL""",
}
