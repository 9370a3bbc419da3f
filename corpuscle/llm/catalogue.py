"""The queries of this subpackage over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fertility, katz, langid, licences, neardup, packing, shards, store, tokenfile, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 4096, end_id=1)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(documents.drop("lang"), model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.place(spark, "token-store")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return tokenfile.read(spark, path, ids=False)


@query
def op4_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> list[int]:
    """The table of CRC-32 by its reversed polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 if x & 1 else x >> 1 for x in out]
    return out


#: CRC-32 of a blob given in hexadecimal digits.
CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({{hex}}) // 2), lambda i: ('0x' || substr({{hex}}, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, {crc_table()}[(xor(c, b) & 255) + 1])))"""

ORACLES["op4_prefix_sum_shards"] = f"""
WITH h AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS hx FROM documents),
r AS (SELECT doc_id, (length(hx) // 2 + 1)::BIGINT AS size, {CRC32.format(hex="hx")}::BIGINT AS text_crc32 FROM h),
p AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS n, sum(size) OVER () AS total FROM r
      WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""


@query
def op5_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = fertility.judge(documents, tokenizer("piece_bpe_32k.model"), tokenizer())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", *fertility.MEASURES[:1], "word_chars_per_token", "byte_share", "entropy")


@query
def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


@query
def op7_block_max_wand_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")


@query
def op8_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.col("n_lines").cast("long").alias("n_lines"), F.array_join("notices", " ").alias("notices"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """licences.canonical_lines in DuckDB's SQL."""
    t = f"chr(10) || translate(lower({text}), chr(9) || chr(13) || chr(11) || chr(12), '    ')"
    t = f"regexp_replace({t}, {quoted(licences.COPYRIGHT)}, chr(10), 'g')"
    for word, same in licences.SPELLINGS:
        t = f"replace({t}, {quoted(word)}, {quoted(same)})"
    t = f"regexp_replace({t}, {quoted(licences.PUNCTUATION)}, ' ', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)"


ORACLES["op9_licence_digests"] = f"""
WITH k AS (SELECT sha256(array_to_string({canonical_sql("t")}, ' ')) AS digest, min(l) AS license
           FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licences.known_texts())}) v(l, t) GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS id, {canonical_sql("text")} AS ls FROM documents),
n AS (SELECT id, string_agg(license, ' ' ORDER BY license) AS notices FROM (SELECT id, unnest(ls) AS l FROM d) JOIN k ON k.digest = sha256(l) GROUP BY id)
SELECT doc_id, w.digest, license, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(notices, '') AS notices
FROM (SELECT *, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END AS digest FROM d) w LEFT JOIN n USING (id) LEFT JOIN k USING (digest)"""

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEAST_GOOD, Z = 0.5, 1.645


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled outcome for each page whose document (its number in the url's path) has labels: good if of quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("url", F.expr(r"try_cast(nullif(regexp_extract(url, '/[a-z][a-z]/([0-9]+)', 1), '') as bigint)").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return pages.join(labels, "doc_id").select(urls.host_of(F.col("url")).alias("host"), "good")


@query
def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes(spark, sf_dir), RULES, LEAST_GOOD, Z)
    return found.select("page_id", "host", "path", "rule", "verdict")


def moments_sql(groups: str) -> str:
    """urls.strength in SQL."""
    return f"""(SELECT CASE WHEN count(*) <= 1 THEN 1.0 ELSE coalesce((SELECT CASE WHEN v > 0 AND lft > 0 AND (s - v * (k - 1)) / (v * lft) > 0 THEN least(greatest(1 / ((s - v * (k - 1)) / (v * lft)) - 1, 1.0), 1000.0) END
      FROM (SELECT count(*) AS k, sum(n * (good::DOUBLE / n - prior) ** 2) AS s, sum(n * prior * (1 - prior)) / sum(n) AS v, sum(n) - sum(n * n)::DOUBLE / sum(n) - count(*) + 1 AS lft FROM {groups})), 1000.0) END FROM {groups})"""


def host_sql(url: str) -> str:
    return f"coalesce(translate(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '')"


def levels_sql(source: str) -> str:
    """urls.levels_of in SQL: the rows of a source with site, domain and suffix of their host."""
    site = f"regexp_replace(regexp_replace(regexp_replace(host, '{urls.USER}', ''), '{urls.PORT}', ''), '{urls.DOTS}', '')"
    country = f"len(parts) > 1 AND length(parts[-1]) = 2 AND parts[-2] IN ({', '.join(map(quoted, urls.SECOND_LEVEL))})"
    part = lambda n: f"array_to_string(CASE WHEN two THEN parts[-{n + 1}:] ELSE parts[-{n}:] END, '.')"
    return f"""(SELECT *, CASE WHEN address THEN site ELSE {part(2)} END AS domain, CASE WHEN address THEN 'address' ELSE {part(1)} END AS suffix
      FROM (SELECT *, {country} AS two, regexp_matches(site, {quoted(urls.ADDRESS)}) AS address FROM (SELECT *, string_split(site, '.') AS parts FROM (SELECT *, {site} AS site FROM {source}))))"""


POSTERIOR = "good + m * prior AS a, n - good + m * (1 - prior) AS b"
ORACLES["op10_host_reputation"] = f"""
WITH lab AS (SELECT {host_sql("p.url")} AS host, quality = 1 AND toxic = 0 AS good FROM pages p JOIN labels l ON l.doc_id = try_cast(nullif(regexp_extract(p.url, '/[a-z][a-z]/([0-9]+)', 1), '') AS BIGINT)),
h AS (SELECT site, domain, suffix, count(*) AS n, count(*) FILTER (good) AS good FROM {levels_sql("lab")} WHERE good IS NOT NULL GROUP BY ALL),
al AS (SELECT (coalesce(sum(good), 0) + 1)::DOUBLE AS a, (coalesce(sum(n), 0) - coalesce(sum(good), 0) + 1)::DOUBLE AS b FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT a / (a + b) FROM al) AS prior FROM h GROUP BY suffix), ms AS (SELECT {moments_sql("s")} AS m), s2 AS (SELECT *, {POSTERIOR} FROM s, ms),
d AS (SELECT suffix, domain, sum(h.n) AS n, sum(h.good) AS good, any_value(a / (a + b)) AS prior FROM h JOIN s2 USING (suffix) GROUP BY suffix, domain), md AS (SELECT {moments_sql("d")} AS m), d2 AS (SELECT *, {POSTERIOR} FROM d, md),
g AS (SELECT site, h.n, h.good, a / (a + b) AS prior FROM h JOIN d2 USING (domain, suffix)), mg AS (SELECT {moments_sql("g")} AS m), g2 AS (SELECT *, {POSTERIOR} FROM g, mg),
w AS (SELECT mg.m / (mg.m + 1) AS wg, md.m / (md.m + 1) AS wd, ms.m / (ms.m + 1) AS ws FROM mg, md, ms),
pg AS (SELECT page_id, {host_sql("url")} AS host, coalesce(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
x AS (SELECT page_id, pg.host, path, coalesce(g2.a, d2.a, s2.a, al.a) AS a, coalesce(g2.b, d2.b, s2.b, al.b) AS b,
      CASE WHEN g2.a IS NOT NULL THEN 1 WHEN d2.a IS NOT NULL THEN wg WHEN s2.a IS NOT NULL THEN wg * wd ELSE wg * wd * ws END AS below,
      CASE WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
           WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
           WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
           WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
           WHEN (pg.host = 'org' OR pg.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM {levels_sql("pg")} pg LEFT JOIN g2 ON g2.site = pg.site LEFT JOIN d2 ON d2.domain = pg.domain LEFT JOIN s2 ON s2.suffix = pg.suffix, al, w),
y AS (SELECT *, a / (a + b) AS mean, 1 - (a + b) / (a + b + 1) * below AS share FROM x)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mean - {Z} * sqrt(mean * (1 - mean) * share) >= {LEAST_GOOD} THEN 'allow' ELSE 'block' END AS verdict FROM y"""
