"""The operators' queries over whole tables, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import chat, exact_dedup, language, media, mixing, quality, sentencepiece_bpe, similarity, toxicity, urls
from granary.llm.common import bound_batches, held_out, table

PIECES = "piece_bpe_32k.model"


#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    tokens = chat.ModelTokens(public_tokenizers.path(PIECES))
    return chat.read_back(chat.format_windows(rows.unionByName(more), tokens=tokens), in_order=True)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad where the row of ``labels`` with its id has quality 0."""
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg((1 - F.max("quality")).cast("bigint").alias("bad"))
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"), F.round("bad_bound", 6).alias("bad_bound"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_bpe.encode_column(docs, model_path or public_tokenizers.path(PIECES))
    return encoded.select("doc_id", *sentencepiece_bpe.digests(encoded))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.sniff(media.store_texts(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.UNIT, media.UNIT)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "media_type",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return toxicity.score(docs, index).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "nearest_id", "similarity")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join_similar(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return quality.score(docs, forest).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    contents = language.fit(docs.where(~held_out("doc_id", 4, 2)))
    return language.identify(docs.select("doc_id", "text"), contents).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def _owned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_mixing, op2_chat, op3_urls, op4_sentencepiece, op5_media, op6_toxicity, op7_exact_dedup, op8_similarity, op9_quality, op10_language)
    return {f.__name__: _owned(f) for f in listed}


def _level_sql(name: str, groups: str, parent: str, prior: str, on: str) -> str:
    """Posteriors of one level of hosts from the prior means of the level above."""
    return f"""{name}_prior AS (SELECT g.*, {prior} AS prior FROM {groups} g JOIN {parent} u ON {on}),
{name}_spread AS (SELECT least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.01), 0.001), 0.9) AS rho FROM {name}_prior),
{name} AS (SELECT g.*, (k + (1 / rho - 1) * prior) / (n + 1 / rho - 1) AS m, n + 1 / rho - 1 AS strength FROM {name}_prior g, {name}_spread)"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
    two = ", ".join(f"'{s}'" for s in urls.TWO_LABELS)
    return f"""WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
parsed AS (SELECT *, regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') AS site FROM split),
outcomes AS (SELECT doc_id AS page_id, 1 - max(quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
counted AS (SELECT site AS host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY site),
ends AS (SELECT *, regexp_extract(host, '[^.]*$') AS one, regexp_extract(host, '([^.]*[.])?[^.]*$') AS two, regexp_extract(host, '([^.]*[.])?([^.]*[.])?[^.]*$') AS three FROM counted),
hosts AS (SELECT host, n, k, CASE WHEN two IN ({two}) THEN three ELSE two END AS domain, CASE WHEN two IN ({two}) THEN two ELSE one END AS suffix FROM ends),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
everything AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m FROM suffixes),
{_level_sql("top", "suffixes", "everything", "u.m", "true")},
{_level_sql("middle", "domains", "top", "u.m", "g.suffix = u.suffix")},
{_level_sql("own", "hosts", "middle", "u.m", "g.domain = u.domain")},
spans AS (SELECT host, m, m * strength AS a, (1 - m) * strength AS b FROM own),
grids AS (SELECT *, ln(a / b) AS top, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) * {urls.SPAN / (urls.POINTS - 1)!r}::DOUBLE AS step FROM spans),
points AS (SELECT *, unnest(range({urls.POINTS})) AS i FROM grids), placed AS (SELECT *, top + (i - {urls.POINTS // 2}) * step AS u FROM points),
cells AS (SELECT *, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - (a * top - (a + b) * (greatest(top, 0) + ln(1 + exp(-abs(top)))))) AS w FROM placed),
sums AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, {urls.TAIL} * sum(w) OVER (PARTITION BY host) AS wanted FROM cells),
known AS (SELECT host, m AS bad_share, 1 / (1 + exp(-(top + (i + (wanted - (s - w)) / w - {urls.POINTS // 2}) * step - step / 2))) AS bad_bound FROM sums WHERE s >= wanted AND s - w < wanted),
rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT DISTINCT host, path, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC, verdict DESC) = 1)
SELECT page_id, parsed.host AS host, parsed.path AS path, rule, coalesce(verdict, CASE WHEN bad_bound > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(bad_share, 6) AS bad_share, round(bad_bound, 6) AS bad_bound
FROM parsed JOIN known ON site = known.host LEFT JOIN best ON best.host = parsed.host AND best.path = parsed.path"""


#: Weighted sampling without replacement up to what whole epochs leave of each source's target.
_MIX = """WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, text FROM documents),
weights AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0 ELSE 0.5 END AS weight FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
named AS (SELECT d.*, coalesce(w.weight, 1)::DOUBLE AS weight, coalesce(d.doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || size AS name FROM docs d LEFT JOIN weights w USING (doc_id)),
keyed AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(name), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS key FROM named),
sources AS (SELECT source, sum(size)::DOUBLE AS source_size, 3 * sum(size)::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM keyed GROUP BY source),
levels AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER f - cap)) / (sum(w) OVER () - (sum(w) OVER f - w)) AS level FROM sources WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
aims AS (SELECT *, least(cap, w * (SELECT max(level) FROM levels WHERE cap / w >= level)) AS target FROM levels),
rests AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-12)) ELSE 0 END AS epochs FROM aims),
placed AS (SELECT k.*, source_size, target, epochs, greatest(target - epochs * source_size, 0) AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, size, k.doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed"""


def _little_endian(value: str) -> str:
    return f"(substr(printf('%08X', {value}), 7, 2) || substr(printf('%08X', {value}), 5, 2) || substr(printf('%08X', {value}), 3, 2) || substr(printf('%08X', {value}), 1, 2))"


#: Payloads in hexadecimal digits behind the head of a WAV file of 8-bit samples, 8000 a second, and their bytes one by one.
_MEDIA = f"""WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
payloads AS MATERIALIZED (SELECT r, doc_id, length(h) // 2 AS n_bytes, h || repeat('00', greatest(64, (length(h) // 2 + 63) // 64 * 64)::INTEGER - length(h)::INTEGER // 2) AS p FROM raw),
media AS MATERIALIZED (SELECT *, length(p) // 2 AS n, '52494646' || {_little_endian("length(p) // 2 + 36")} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_little_endian("length(p) // 2")} || p AS m FROM payloads),
bytes AS MATERIALIZED (SELECT r, i, ('0x' || substr(p, 2 * i + 1, 2))::BIGINT AS b FROM (SELECT r, p, unnest(range(0, n)) AS i FROM media)),
shares AS (SELECT r, sum(c * log2(c / total)) / min(total) AS e FROM (SELECT r, count(*) AS c, sum(count(*)) OVER (PARTITION BY r) AS total FROM bytes GROUP BY r, b) GROUP BY r),
levels AS (SELECT r, sum(b - 128) / count(*) AS mean, sqrt(sum((b - 128) * (b - 128)) / count(*)) AS rms, max(b) AS peak, count(*) FILTER (turned) AS crossings FROM (SELECT *, (b > 127) <> lag(b > 127) OVER (PARTITION BY r ORDER BY i) AS turned FROM bytes) GROUP BY r),
crc AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes),
tails AS (SELECT r, list(b ORDER BY i) AS bs FROM bytes JOIN (SELECT r, n FROM media) USING (r) WHERE i >= n - 64 GROUP BY r)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(p)) AS payload_sha256, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) AS tail_crc32,
length(m) // 2 AS media_bytes, sha256(unhex(m)) AS media_sha256, printf('n=%d;entropy=%.4f;mean=%.4f;rms=%.4f;peak=%d;crossings=%d', n, -e, mean, rms, peak, crossings) AS feature, 'audio/wav' AS media_type
FROM media JOIN shares USING (r) JOIN levels USING (r) JOIN tails USING (r), crc"""

#: All pairs of documents that share a shingle, and what can be reached by those that are similar.
_SIMILAR = """WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM split UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL gives the same rows over whole tables in reasonable time."""
    return {
        "op1_mixing": _MIX,
        "op5_media": _MEDIA,
        "op8_similarity": _SIMILAR,
        "op3_urls": _urls_sql(),
        "op7_exact_dedup": """WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
    }
