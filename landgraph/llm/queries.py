"""The numbered queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgraph.llm import oracles
from landgraph.llm.byte_bpe import decode_ids, encode_texts
from landgraph.llm.common import Scratch
from landgraph.llm.decontaminate import contaminated
from landgraph.llm.hidden_markov import score_texts
from landgraph.llm.licenses import TEMPLATES, scan_licenses
from landgraph.llm.line_dedup import dedup_lines
from landgraph.llm.merkle import Manifest, folded, leaf_digest, proof_digest
from landgraph.llm.near_dedup import near_duplicates
from landgraph.llm.nn_descent import near_vectors
from landgraph.llm.packing import pack_documents
from landgraph.llm.passages import repeated_passages
from landgraph.llm.quality import classify
from landgraph.llm.spelling import count_words, spelling_variants
from landgraph.llm.warc import read_archives, write_archives
from landgraph.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scratch = table(spark, sf_dir, "pages"), Scratch(spark, "warc")
    write_archives(pages, scratch.path("archives"), payload=F.col("html"))
    back = read_archives(spark, scratch.path("archives"))
    return back.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        F.substring_index("digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers").cast("long").alias("refers_to"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), min_length=5, min_count=3, delete_every=97)
    return spelling_variants(words, ratio=2)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    without_breaks = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in fields]
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    manifest = Manifest(table(spark, sf_dir, "documents"), fields=fields, carry={"tampered": F.when(tampers, leaf_digest(without_breaks))})
    rows = manifest.proofs().withColumn("folded_root", folded(F.coalesce("member.tampered", "leaf"), F.col("path")))
    proof = proof_digest(F.col("path")).alias("proof_sha256")
    return rows.select(F.col("member.id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = decode_ids(encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, F.sha2("decoded", 256).alias("decoded_sha256"))


_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, unhex(sha1(b)) AS raw, sha1(b) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex),
bits AS (SELECT page_id, n, d.hex, first, list_transform(range(32), lambda i: list_sum(list_transform(range(5), lambda j:
   ((strpos('0123456789abcdef', substr(d.hex, CAST((i * 5 + j) // 4 AS INT) + 1, 1)) - 1) >> CAST(3 - (i * 5 + j) % 4 AS INT)) % 2 * (1 << CAST(4 - j AS INT))))) AS q FROM d JOIN f ON d.hex = f.hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM bits""",
}


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    words = r"list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    grams = "CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return rf"""
WITH t AS (SELECT license, {grams} AS g FROM (SELECT license, {words.format('body')} AS w FROM (VALUES {values}) v(license, body))),
tg AS (SELECT license, len(g) AS n, unnest(g) AS gram FROM t),
src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, doc_id, text, string_split(text, chr(10)) AS ls, string_split_regex(text, '\n[\t ]*\n') AS bs,
  string_split(regexp_replace(text, '([.!?])[ \t\r\n]+([\p{{Lu}}"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM src),
u AS (SELECT r, doc_id, 'line' AS unit, CAST(unnest(range(len(ls))) AS INT) AS unit_no, unnest(ls) AS body FROM cut
  UNION ALL SELECT * FROM (SELECT r, doc_id, 'block' AS unit, CAST(unnest(range(len(bs))) AS INT) AS unit_no, unnest(bs) AS body FROM cut) WHERE contains(body, chr(10))
  UNION ALL SELECT r, doc_id, 'sentence', CAST(unnest(range(len(ss))) AS INT), unnest(ss) FROM cut WHERE len(ss) > 1
  UNION ALL SELECT r, doc_id, 'text', 0, text FROM cut WHERE len(bs) > 1),
uw AS (SELECT r, doc_id, unit, unit_no, {words.format('body')} AS w FROM u),
ug AS (SELECT r, doc_id, unit, unit_no, {grams} AS g FROM uw),
ux AS (SELECT r, doc_id, unit, unit_no, len(g) AS n, unnest(g) AS gram FROM ug),
s AS (SELECT ux.r, ux.doc_id, ux.unit, ux.unit_no, license, 2.0 * count(*) / (ux.n + tg.n) AS dice
  FROM ux JOIN tg USING (gram) GROUP BY ux.r, ux.doc_id, ux.unit, ux.unit_no, license, ux.n, tg.n)
SELECT doc_id, unit, unit_no, license, CAST(dice AS DOUBLE) AS dice FROM s WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, unit, unit_no ORDER BY dice DESC, license) = 1"""


SQL |= {"op8_license_scan": _license_sql(), "op11_spelling_variants": oracles.SPELLING, "op12_merkle_manifest": oracles.MERKLE}

QUERIES = {
    f.__name__: f
    for f in (
        op1_nn_descent, op2_line_dedup, op3_decontamination, op4_quality_classifier, op5_best_fit_packing, op6_warc, op7_substring_dedup,
        op8_license_scan, op9_minhash_near_dedup, op10_hidden_markov, op11_spelling_variants, op12_merkle_manifest, op13_byte_bpe,
    )
}
