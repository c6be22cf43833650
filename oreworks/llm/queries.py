"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from oreworks.llm import conversations, language, licenses, resampling, secrets, urls
from oreworks.llm.mixing import mix
from oreworks.llm.near_duplicates import near_duplicates
from oreworks.llm.packing import pack_sequences
from oreworks.llm.quality import quality
from oreworks.llm.simhash import compare_with_edits
from oreworks.llm.token_counts import count_tokens
from oreworks.llm.top_k import top_k
from oreworks.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"),
    )


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.learn(docs))
    kinds = F.split("base", ",")
    count = lambda kind: F.size(F.filter(kinds, lambda span: span.startswith(f"{kind}:"))).cast("long")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024."""
    pieces = pack_sequences(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that every source has the same share of the characters."""
    return mix(table(spark, sf_dir, "documents"))


ORACLES["op2_mixing"] = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source HAVING size > 0),
wholes AS (
    SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes) * (SELECT sum(size) FROM sizes)::DOUBLE / size AS whole FROM sizes),
rates AS (
    SELECT source, greatest(1, CAST(ceil(whole / 64.0::DOUBLE) AS BIGINT)) AS lanes, whole / lanes AS rate FROM wholes),
poisson AS (
    SELECT source, rate, 0 AS k, -rate AS term, exp(-rate) AS upto FROM rates
    UNION ALL
    SELECT source, rate, k + 1, term + ln(rate) - ln((k + 1)::DOUBLE), upto + exp(term + ln(rate) - ln((k + 1)::DOUBLE))
    FROM poisson WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 24)),
docs AS (
    SELECT d.*, unnest(range(lanes)) AS lane FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source),
placed AS (
    SELECT *, CAST(('0x' || substr(md5('17' || CASE WHEN lane > 0 THEN '/' || lane ELSE '' END || ':'
                                      || CASE WHEN doc_id IS NULL THEN '' ELSE CAST(doc_id AS VARCHAR) || ':' END
                                      || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS place
    FROM docs),
counts AS (
    SELECT *, (SELECT count(*) FROM poisson p WHERE p.source IS NOT DISTINCT FROM d.source AND round(p.upto, 12) <= d.place) AS n
    FROM placed d)
SELECT doc_id, text, lang, source, n_chars, lane * 1024 + unnest(range(n)) AS copy FROM counts
"""


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every vector whose id is divisible by 100 with all other vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLES["op10_top_k"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
products AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM products)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality(docs, labels, ~held_out(F.col("doc_id")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


_ORDERS = range(urls.ORDER + 1)
ORACLES["op5_urls"] = f"""
WITH parts AS (
    SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
hosts AS (
    SELECT *, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
           regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
        '^^^' || regexp_replace(translate(coalesce(url, ''), '{urls.UPPER}{urls.DIGITS}', '{urls.LOWER}0000000000'),
                                '[^a-z0:/._?=&#\\-]', '*', 'g') || '$' AS text
    FROM hosts),
judged AS (
    SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided
    FROM ruled),
texts AS (
    SELECT text, count(*) FILTER (WHERE decided = 'allow') AS accepted, count(*) FILTER (WHERE decided = 'block') AS rejected
    FROM judged GROUP BY text),
places AS (SELECT *, unnest(range(1, length(text) - 2)) AS place FROM texts),
grams AS (
    SELECT substr(text, place, 4) AS gram, sum(accepted)::DOUBLE AS accepted, sum(rejected)::DOUBLE AS rejected
    FROM places GROUP BY gram),
{"".join(f"""
seen{k} AS (SELECT substr(gram, {4 - k}, {k + 1}) AS tail, sum(accepted) AS a, sum(rejected) AS r FROM grams GROUP BY tail),
all{k} AS (SELECT substr(gram, {4 - k}, {k}) AS context, sum(accepted) AS a, sum(rejected) AS r FROM grams GROUP BY context),"""
for k in _ORDERS)}
model0 AS (
    SELECT gram, (s.a + 2.0::DOUBLE * (1.0::DOUBLE / 41)) / (t.a + 2.0::DOUBLE) AS pa,
           (s.r + 2.0::DOUBLE * (1.0::DOUBLE / 41)) / (t.r + 2.0::DOUBLE) AS pr
    FROM grams JOIN seen0 s ON s.tail = substr(gram, 4, 1) JOIN all0 t ON t.context = ''),
{",".join(f"""
model{k} AS (
    SELECT m.gram, (s.a + 2.0::DOUBLE * pa) / (t.a + 2.0::DOUBLE) AS pa, (s.r + 2.0::DOUBLE * pr) / (t.r + 2.0::DOUBLE) AS pr
    FROM model{k - 1} m JOIN seen{k} s ON s.tail = substr(m.gram, {4 - k}, {k + 1})
    JOIN all{k} t ON t.context = substr(m.gram, {4 - k}, {k}))""" for k in _ORDERS if k)},
ratios AS (SELECT gram, CAST(round((ln(pa) - ln(pr)) * 1e6) AS BIGINT) AS ratio FROM model3),
scored AS (
    SELECT p.text, any_value(p.accepted) AS accepted, any_value(p.rejected) AS rejected,
           CAST(floor(sum(ratio)::DOUBLE / count(*)) AS BIGINT) AS score
    FROM places p JOIN ratios r ON r.gram = substr(p.text, p.place, 4) GROUP BY p.text),
moments AS (
    SELECT sum(accepted)::DOUBLE AS n1, sum(accepted * score)::DOUBLE / n1 AS m1,
           sqrt(greatest(sum(accepted * score * score)::DOUBLE / n1 - m1 * m1, 1)) AS d1,
           sum(rejected)::DOUBLE AS n0, sum(rejected * score)::DOUBLE / n0 AS m0,
           sqrt(greatest(sum(rejected * score * score)::DOUBLE / n0 - m0 * m0, 1)) AS d0
    FROM scored)
SELECT page_id, host, path, rule, score,
       coalesce(decided, CASE WHEN score >= (SELECT CASE WHEN n1 > 0 AND n0 > 0 THEN (m1 * d0 + m0 * d1) / (d1 + d0) ELSE 0 END
                                             FROM moments) THEN 'allow' ELSE 'block' END) AS verdict
FROM judged JOIN scored USING (text)
"""


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among the texts of all documents and their lines."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _values(entries) -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in entries)


def _lines(text: str) -> str:
    words = f"regexp_replace(replace(lower({text}), '©', ' copyright '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for spelling, usual in licenses.SPELLINGS:
        usual = usual.replace("$", "\\")
        words = f"regexp_replace({words}, '{spelling}', '{usual}', 'g')"
    return f"list_filter(list_transform(string_split({words}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_WHOLE = f"md5(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{licenses.LEFT_OUT}')), ' '))"
ORACLES["op6_licenses"] = f"""
WITH texts AS (SELECT * FROM (VALUES {_values(licenses.LICENSES)}) t(license, text)),
stated AS (SELECT * FROM (VALUES {_values(licenses.NOTICES)}) t(license, text)),
texts_by AS (
    SELECT digest, min(license) AS license FROM (
        SELECT license, {_WHOLE} AS digest FROM (SELECT license, {_lines("text")} AS lines FROM texts)
        UNION ALL SELECT * FROM (VALUES {_values(licenses.DIGESTS)}) t(license, digest)) GROUP BY 1),
stated_by AS (SELECT md5(array_to_string(lines, ' ')) AS digest, min(license) AS notice FROM (SELECT license, {_lines("text")} AS lines FROM stated) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS n, doc_id, {_lines("coalesce(text, '')")} AS lines FROM documents),
whole AS (SELECT n, doc_id, {_WHOLE} AS digest FROM docs),
lines AS (SELECT n, md5(unnest(lines)) AS digest FROM docs),
found AS (
    SELECT n, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT notice)), ',') AS notices
    FROM lines JOIN stated_by USING (digest) GROUP BY n)
SELECT doc_id, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN texts_by USING (digest) LEFT JOIN found USING (n)
"""


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after damage."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the long enough documents, drawn towards the benchmark's texts; all documents are returned."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target).drop("n_words")


# CRC-32 bit by bit, then a byte at a time over the hexadecimal digits of a feature.
ORACLES["op13_resampling"] = """
WITH RECURSIVE bits AS (
    SELECT b AS byte, b::UBIGINT AS crc, 0 AS done FROM range(256) t(b)
    UNION ALL
    SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END, done + 1
    FROM bits WHERE done < 8),
crcs AS (SELECT list(crc ORDER BY byte) AS crcs FROM bits WHERE done = 8),
words AS (
    SELECT row_number() OVER () AS n, doc_id, NULL AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT NULL, NULL, item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
    SELECT n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words),
different AS (SELECT DISTINCT feature FROM features),
hashed AS (
    SELECT feature, xor(list_reduce(
        list_transform(range(0, strlen(feature)), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS UBIGINT)),
        lambda crc, byte: xor(crc >> 8, crcs[CAST(xor(crc, byte) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT),
        4294967295::UBIGINT) % 10000 AS bucket
    FROM different, crcs),
counted AS (
    SELECT bucket, count(n) AS s, count(*) - count(n) AS t FROM features JOIN hashed USING (feature) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE)
                                        / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain
    FROM counted),
weights AS (
    SELECT n, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
    FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE n IS NOT NULL GROUP BY n),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
                                                                 AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (n) WHERE n IS NOT NULL),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
           count(*) FILTER (WHERE n_words >= 20) OVER () AS long
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * long // 100 THEN place END AS rank FROM placed
"""
