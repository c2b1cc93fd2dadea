"""The registered queries of this subpackage, each over the whole of its table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontamination, exact_dedup, html_text, language, merkle, packing, pii, pitman_yor, quality, resampling, simhash, url_filter, warc

#: Vocabulary of the packing query, a file of the installed collection of public tokenizers.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [
    url_filter.Rule("net", "/", allow=False),
    url_filter.Rule("example.net", "/en/", allow=True),
    url_filter.Rule("example.com", "/de/", allow=False),
    url_filter.Rule("org", "/fr/", allow=True),
]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(_table(spark, sf_dir, "documents"))


def _remainder(id_col: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, _remainder("doc_id", 4) != 2)
    found = language.classify(docs, model)
    return found.withColumn("held_out", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, keep_payload=False).drop("payload", "url", "problem")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 7) == 2, F.lit(False))
    model = pitman_yor.train(docs.filter(~held_out))
    return pitman_yor.score(docs, model).withColumn("held_out", held_out)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return pii.spans(_table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(_remainder("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaves = {"own": merkle.leaf(cells), "tampered": merkle.leaf([*cells[:3], tampered, cells[4]])}
    found = merkle.verify(merkle.manifest(_table(spark, sf_dir, "documents"), "doc_id", "lang", leaves), "tampered")
    shown = {"leaf": F.col("leaves.own"), "subroot": F.col("subroot"), "root": F.col("root"), "folded_root": F.col("folded_root")}
    return found.select("doc_id", *(F.lower(F.hex(c)).alias(k) for k, c in shown.items()), merkle.proof(F.col("path")).alias("proof_sha256"), "verified")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_exact_dedup, op4_language, op5_packing, op6_quality, op7_warc, op8_url_filter, op9_html_text, op10_lm_scoring, op11_importance_resampling, op12_personal_data, op13_merkle_manifest)}


#: CRC-32 for DuckDB: its table by bytes, and that of a list of bytes, as a macro would have it.
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i))"""


def _crc_sql(text: str) -> str:
    byte = f"lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), {byte})), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_importance_resampling": rf"""
            WITH words AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
                FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, text FROM benchmark)
            ),
            features AS (
                SELECT doc_id, len(w) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
            ),
            buckets AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), {CRC_TABLE}),
            counted AS (SELECT doc_id, n_words, bucket, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
            totals AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id >= 0), 0) AS s, coalesce(sum(n) FILTER (doc_id < 0), 0) AS t FROM counted GROUP BY bucket),
            gains AS (
                SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals
            ),
            weighed AS (
                SELECT doc_id, coalesce(any_value(n_words), 0) AS n_words, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT), 0) AS weight
                FROM documents LEFT JOIN (counted JOIN gains USING (bucket)) USING (doc_id) GROUP BY doc_id
            ),
            scored AS (
                SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed
            ),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM scored)
            SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM ranked
        """,
        "op13_merkle_manifest": rf"""
            WITH RECURSIVE cells AS (
                SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z,
                    n_chars + CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN 1 ELSE 0 END AS changed
                FROM documents, {CRC_TABLE}
            ),
            leaves AS (
                SELECT doc_id, coalesce(lang, '') AS g, lang IS NOT NULL AS known, sha256(a || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
                    sha256(a || coalesce(length(changed::VARCHAR) || ':' || changed, '-') || z) AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i
                FROM cells
            ),
            lower AS (
                SELECT known, g, 0 AS k, i, leaf AS d FROM leaves
                UNION ALL
                SELECT known, g, k + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM lower GROUP BY known, g, k, i // 2
                HAVING (SELECT count(*) FROM lower) > 0 AND k < 40
            ),
            sizes AS (SELECT known, g, k, count(*) AS n FROM lower GROUP BY ALL),
            depth AS (SELECT known, g, min(k) AS top FROM sizes WHERE n = 1 GROUP BY ALL),
            subroots AS (SELECT known, g, d AS subroot, top, row_number() OVER (ORDER BY known, g) - 1 AS j FROM depth JOIN lower USING (known, g) WHERE k = top),
            upper AS (
                SELECT 0 AS k, j AS i, subroot AS d FROM subroots
                UNION ALL
                SELECT k + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM upper GROUP BY k, i // 2 HAVING k < 40
            ),
            crown AS (SELECT min(k) AS height FROM (SELECT k FROM upper GROUP BY k HAVING count(*) = 1)),
            steps AS (
                SELECT doc_id, k AS level, i, d FROM (
                    SELECT doc_id, lower.k AS k, lower.i AS i, d FROM leaves l JOIN depth USING (known, g) JOIN lower ON lower.known = l.known AND lower.g = l.g AND lower.k < top AND lower.i = xor(l.i >> lower.k, 1)
                    UNION ALL
                    SELECT doc_id, 100 + upper.k, upper.i, d FROM leaves l JOIN subroots USING (known, g), crown JOIN upper ON upper.k < height AND upper.i = xor(j >> upper.k, 1)
                )
            ),
            all_levels AS (
                SELECT doc_id, lower.k AS level, l.i >> lower.k AS own FROM leaves l JOIN depth USING (known, g) JOIN (SELECT DISTINCT k FROM lower) lower ON lower.k < top
                UNION ALL
                SELECT doc_id, 100 + upper.k, j >> upper.k FROM leaves l JOIN subroots USING (known, g), crown JOIN (SELECT DISTINCT k FROM upper) upper ON upper.k < height
            ),
            way AS (
                SELECT doc_id, list({{'own': own, 'sib': d}} ORDER BY level) AS path, coalesce(string_agg(d, '' ORDER BY level), '') AS told FROM all_levels LEFT JOIN steps USING (doc_id, level) GROUP BY doc_id
            ),
            folded AS (
                SELECT doc_id, leaf, subroot, (SELECT d FROM upper JOIN crown ON k = height) AS root, sha256(coalesce(told, '')) AS proof_sha256,
                    list_reduce(list_prepend({{'own': 0, 'sib': tampered}}, coalesce(path, [])), lambda x, y: {{'own': 0, 'sib': sha256(CASE WHEN y.sib IS NULL THEN x.sib WHEN y.own % 2 = 0 THEN x.sib || y.sib ELSE y.sib || x.sib END)}}).sib AS folded_root
                FROM leaves JOIN subroots USING (known, g) LEFT JOIN way USING (doc_id)
            )
            SELECT *, folded_root = root AS verified FROM folded
        """,
        "op3_exact_dedup": r"""
            SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            WINDOW same AS (PARTITION BY t)
        """,
        "op7_warc": r"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
            SELECT page_id, octet_length(encode(t)) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
                   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to
            FROM f
        """,
    }
