"""The thirteen contract queries, two that show what SQL can say of others, and their SQL. Each reads its whole table through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import embed, extract, langid, middle, minhash, mixing, packing, quality, runs, secrets, shards, suffix, warc
from gaitframe.llm.shared import WORD, shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.whole(warc.read_archives(spark, path, payloads=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.repeated_spans(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    # of rows that share the smallest id of a component, the operator keeps one; the contract's rule goes by the id
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: the counts of the stated patterns."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the stated measures and rules."""
    return quality.measures(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts repeat a stretch of their words from some word on to their end, as the contract says.

    Other texts are not split, and no text is read twice.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).cast("long").alias("g"))
    listed = chosen.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    sized = listed.withColumn("n", F.coalesce(F.size("words"), F.lit(-1)))
    at = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    at = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), rest), " ")
    return at.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(_made_periodic(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_best_fit_packing, op2_secret_scan, op3_quality_rules, op4_warc_salvage, op5_language_id, op6_suffix_dedup, op7_byte_shards, op8_source_mix, op9_minhash_dedup, op10_multi_index_dedup, op11_fill_in_middle, op12_html_extraction, op13_periodic_runs, secret_counts, text_measures)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_salvage": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
            SELECT page_id, n AS payload_bytes, digest AS payload_digest,
                   CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
            FROM f""",
        "op8_source_mix": r"""
            WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
            s AS (SELECT source, sum(size)::DOUBLE AS n,
                         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS w FROM d GROUP BY source),
            levels AS (SELECT a.source, a.n, a.w, 3 * a.n AS cap,
                       ((SELECT sum(n) FROM s) - (SELECT coalesce(sum(3 * b.n), 0) FROM s b WHERE (3 * b.n / b.w, coalesce(b.source, chr(1114111))) < (3 * a.n / a.w, coalesce(a.source, chr(1114111)))))
                       / (SELECT sum(b.w) FROM s b WHERE (3 * b.n / b.w, coalesce(b.source, chr(1114111))) >= (3 * a.n / a.w, coalesce(a.source, chr(1114111)))) AS level FROM s a),
            t AS (SELECT source, n, least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE cap >= level * w)) AS target FROM levels),
            r AS (SELECT d.doc_id, d.size, t.n, t.target, t.target / nullif(t.n, 0) AS rate,
                         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS drawn
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
                   (size * (floor(coalesce(rate, 0)) + CASE WHEN drawn < coalesce(rate, 0) - floor(coalesce(rate, 0)) THEN 1 ELSE 0 END))::BIGINT AS taken
            FROM r""",
        "op11_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
            h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
            o AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:z], ''), '') AS mid, coalesce(array_to_string(u[z + 1:n], ''), '') AS suf FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(t) AS restored_sha256
            FROM o""",
        # the given pages mark their article, whose blocks are h1 and p, and hold two character references
        "op12_html_extraction": r"""
            WITH a AS (SELECT page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(?:p|h1)>') AS parts FROM pages),
            b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g')) AS parts FROM a),
            c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
            t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM c)
            SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
        "secret_counts": r"""
            SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6))::BIGINT AS n_assign,
                   len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex
            FROM documents""",
        "text_measures": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8), h AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM g),
            twice AS (SELECT r, g FROM h GROUP BY r, g HAVING count(*) > 1), hit AS (SELECT r, unnest(range(i, i + 8)) AS i FROM h JOIN twice USING (r, g)), rep AS (SELECT r, count(DISTINCT i) AS n FROM hit GROUP BY r),
            l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed
            FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)""",
    }
