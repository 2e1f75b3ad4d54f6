"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, decontaminate, jaccard, langid, licenses, manifest, packing, revisits, secretscan, sharding, toxicity, urlfilter
from .common import crc32_text, table

TOKENIZER = "word_bpe_49k.json"
#: The rules that op4 judges by.
URL_RULES = [
    urlfilter.Rule("block", "com/en/"),
    urlfilter.Rule("allow", "example.com/en/7"),
    urlfilter.Rule("allow", "net/de/"),
    urlfilter.Rule("block", "example.net/de/8"),
    urlfilter.Rule("block", "org/es/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), leaves=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical", "time", "status", "response_id", "digest", text.alias("headers"))


def op7_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a toxicity model may learn from."""
    return table(spark, sf_dir, "labels").where(crc32_text(F.col("doc_id")) % 5 != 0)


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity_labels(spark, sf_dir))
    held_out = F.coalesce(crc32_text(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


def language_rows(docs: DataFrame) -> DataFrame:
    """The rows that a language model may learn from."""
    return docs.where(crc32_text(F.col("doc_id")) % 4 != 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, langid.fit(language_rows(docs))).select("doc_id", held_out, "lang_pred", "score")


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.fit(docs))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.KINDS[:3]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op12_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = manifest.digest_of([F.col(c) for c in fields])
    # One more where there may be one more; the largest number stays.
    raised = F.coalesce(F.try_add("n_chars", F.lit(1)), F.col("n_chars"))
    tampered = manifest.digest_of([raised if c == "n_chars" else F.col(c) for c in fields])
    claimed = F.when(crc32_text(F.col("doc_id")) % 7 == 0, tampered).otherwise(leaf)
    found = manifest.prove(docs, F.col("lang"), F.col("doc_id"), leaf, claimed, keep=[F.col("doc_id")])
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


#: Rounds of op12 as SQL: each assigns all parts and replaces the entries that have some.
_NEAREST = """SELECT n, part, any_value(v) AS v, min({{'d': d, 'e': entry}}) AS best FROM (
  SELECT p.n, p.part, p.v, c.entry, list_sum([(p.v[i] - c.v[i]) * (p.v[i] - c.v[i]) for i in range(1, len(p.v) + 1)])::BIGINT AS d
  FROM parts p JOIN book{k} c ON c.part = p.part) GROUP BY n, part"""
_ROUND = """near{k} AS MATERIALIZED ({nearest}),
moved{k} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM (
  SELECT part, best.e AS entry, i, sum(v[i])::BIGINT AS s, count(*) AS c FROM near{k}, range(1, (SELECT max(len(v)) FROM parts) + 1) t(i) GROUP BY ALL) GROUP BY part, entry),
book{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m ON m.part = b.part AND m.entry = b.entry)"""

SQL = {
    "op12_slice_codes": """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, * FROM (
    SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT n, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM kept, range(8) t(part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM parts WHERE n <= 16),
""" + ",\n".join(_ROUND.format(k=k, next=k + 1, nearest=_NEAREST.format(k=k)) for k in range(codes.ROUNDS)) + f""",
coded AS MATERIALIZED (
  SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM ({_NEAREST.format(k=codes.ROUNDS)}) GROUP BY n),
shown AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(v, ',') AS x FROM book{codes.ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n), shown
""",
    "op13_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    [coalesce(octet_length(encode(x)) || ':' || x, '-') for x in [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS f,
    coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') AS raised
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM (
    SELECT r, doc_id, lang, sha256(array_to_string(f, '')) AS leaf, sha256(array_to_string([f[1], f[2], f[3], raised, f[5]], '')) AS tampered FROM fields)),
tree AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY p) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, [sha256(nodes[i] || coalesce(nodes[i + 1], '')) for i in range(1, len(nodes) + 1, 2)] FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY q) AS nodes FROM subroots
  UNION ALL
  SELECT lvl + 1, [sha256(nodes[i] || coalesce(nodes[i + 1], '')) for i in range(1, len(nodes) + 1, 2)] FROM top WHERE len(nodes) > 1),
crc AS (
  SELECT r, coalesce(xor(list_reduce([4294967295] || [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')],
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0, false) AS tampers
  FROM leaves),
steps AS (
  SELECT l.r, 0 AS stage, t.lvl, (l.p >> t.lvl) & 1 AS is_right, coalesce(t.nodes[(xor(l.p >> t.lvl, 1)) + 1], '') AS sibling
  FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT l.r, 1, t.lvl, (s.q >> t.lvl) & 1, coalesce(t.nodes[(xor(s.q >> t.lvl, 1)) + 1], '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON len(t.nodes) > 1),
proofs AS MATERIALIZED (
  SELECT r, list({'right': is_right, 'sibling': sibling} ORDER BY stage, lvl) AS steps, sha256(string_agg(sibling, '' ORDER BY stage, lvl)) AS digest FROM steps GROUP BY r),
given AS (
  SELECT l.*, proofs.steps, coalesce(digest, sha256('')) AS digest, crc.tampers FROM leaves l LEFT JOIN proofs USING (r) JOIN crc USING (r)),
folds AS (
  SELECT r, 0 AS k, CASE WHEN tampers THEN tampered ELSE leaf END AS node, steps FROM given
  UNION ALL
  SELECT r, k + 1, sha256(CASE WHEN steps[k + 1]['right'] = 1 THEN steps[k + 1]['sibling'] || node ELSE node || steps[k + 1]['sibling'] END), steps FROM folds WHERE k < len(steps)),
ends AS (SELECT r, arg_max(node, k) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, digest AS proof_sha256, folded_root, folded_root = root AS verified
FROM given g JOIN ends USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM g.lang, (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
""",
    "op5_revisit_resolution": """
WITH base AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, 'day-' || (page_id % 365) AS day, 'day-' || ((page_id + 1) % 365) AS next_day, length(coalesce(html, '')) AS n,
    regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '', 's') AS rest
  FROM pages),
named AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1, 's')), '^www\\.', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1, 's'), '/$', '')
    || regexp_extract(rest, '^[^?]*(\\?.+)$', 1, 's') AS canonical
  FROM base),
records AS (
  SELECT canonical, page_id * 4 AS record_id, page_id * 10 AS time, 0 AS revisit, tag AS etag, day AS modified, tag AS digest, n, '' AS headers FROM named
  UNION ALL SELECT canonical, page_id * 4 + 1, page_id * 10 + 3, 1, CASE WHEN page_id % 4 = 0 THEN 'changed' ELSE tag END, NULL, NULL, n, 'cache-control=max-age=600;content-length=0' FROM named
  UNION ALL SELECT canonical, page_id * 4 + 2, page_id * 10 + 5, 1, NULL, CASE WHEN page_id % 3 <> 0 THEN day END, NULL, n, 'date=' || next_day || ';server=cache' FROM named
  UNION ALL SELECT canonical, page_id * 4 + 3, page_id * 10 - 1, 1, tag, NULL, NULL, n, 'vary=accept' FROM named WHERE page_id % 5 = 0),
latest AS (
  SELECT *, last_value(CASE WHEN revisit = 0 THEN {'id': record_id, 'etag': etag, 'modified': modified, 'n': n} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY time, revisit, record_id ROWS UNBOUNDED PRECEDING) AS r
  FROM records),
judged AS (
  SELECT *, CASE WHEN canonical = '' THEN 'no_url' WHEN r IS NULL THEN 'no_response' WHEN etag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN etag IS NOT NULL AND etag = r.etag OR etag IS NULL AND modified = r.modified THEN 'resolved' ELSE 'mismatch' END AS status
  FROM latest WHERE revisit = 1)
SELECT record_id, canonical, time, status, CASE WHEN status = 'resolved' THEN r.id END AS response_id, CASE WHEN status = 'resolved' THEN r.etag END AS digest,
  CASE WHEN status <> 'resolved' THEN headers ELSE
    'cache-control=' || CASE record_id % 4 WHEN 1 THEN 'max-age=600' ELSE 'max-age=60' END || ';content-length=' || r.n || ';content-type=text/html'
    || CASE WHEN record_id % 4 = 2 THEN ';' || split_part(headers, ';', 1) ELSE '' END || ';etag=' || r.etag || ';last-modified=' || r.modified
    || CASE WHEN record_id % 4 = 3 THEN ';vary=accept' ELSE '' END END AS headers
FROM judged
""",
    "op4_url_filter": """
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS k
  FROM parts p LEFT JOIN rules r ON ends_with('.' || p.host, '.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_template_leaks, op2_ngram_jaccard, op3_kd_shards, op4_url_filter, op5_revisit_resolution, op6_toxic_segments, op7_license_alignment,
        op8_language_id, op9_hash_prefix_forest, op10_bin_completion, op11_secret_field, op12_slice_codes, op13_merkle_manifest,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
