"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embed_dups, filter_audit, htmltext, licenses, mixing, packing, passages, periods, pii, quality, sharding, simhash, warc
from tidemark.llm.staging import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_report(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _of_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.spans_of(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return spans.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined(F.concat("base", "found")).alias("spans"))


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dups.embedding_classes(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(periods.planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can check."""
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that no draw decides; targets to four digits."""
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") + OFF_TIES, 4).alias("target"))


def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many e-mail addresses each text holds, the one fixed form of op8 that SQL can check."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can check."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: Added before rounding, alike in SQL, as engines part at ties.
OFF_TIES = 1.2345678e-7
QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_rules, op2_main_text, op3_mix_sources, op4_pack, op5_warc_revisits, op6_shared_passages, op7_simhash, op8_pii, op9_embedding_dups, op10_license_scan, op11_ring_shards, op12_filter_audit, op13_periodic_runs, quality_base_counts, mix_targets, email_counts, license_base_places,
    )
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, c: list_reduce(list_prepend(xor(x, c), CAST(range(8) AS BIGINT[])), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"""
_LICENSE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM i WHERE words[i:i + {len(phrase.split()) - 1}] = {phrase.split()}" for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")))
ORACLES: dict[str, str] = {
    "op12_filter_audit": rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY text) AS original FROM t),
m AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > original, false)] AS fails FROM w),
d AS (SELECT m.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM m LEFT JOIN labels l ON m.doc_id = l.doc_id), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS x), o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS filters FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filters, step, filters[step] AS f, filters[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, array_to_string(list_transform(filters, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, step, f, good, toxic, n, fails[f] AS failed, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_failed FROM c, s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failed AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g""",
    "op5_warc_revisits": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "quality_base_counts": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents), i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM g, (VALUES (0), (1), (2)) t(d) WHERE g.n > 1 GROUP BY doc_id), l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(words) AS base_failed FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id""",
    "mix_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents), s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * source_size / w AS full_at, coalesce(sum(2 * source_size) OVER b, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open FROM s WINDOW b AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((1.5 * (SELECT sum(size) FROM d) - held) / open) FILTER ((1.5 * (SELECT sum(size) FROM d) - held) / open <= full_at) AS level FROM o)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(2e0 * source_size, coalesce(level * w, 2e0 * source_size)) + {OFF_TIES}, 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l""",
    "op13_periodic_runs": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words, {_CRC} AS h FROM documents), g AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
u AS (SELECT r, n, a, coalesce(p, 1) AS p, unnest(range(0, n)) AS i, unnest(words) AS word FROM p),
w AS (SELECT u.r, u.n, u.i, o.word FROM u JOIN u o ON o.r = u.r AND o.i = CASE WHEN u.i < u.a THEN u.i ELSE u.a + (u.i - u.a) % u.p END),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
l AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM l GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.r = s.r AND z.q < s.q AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
b AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(start, length, q), struct_pack(a := -length, b := start, c := q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = w.r AND w.i >= start + q AND w.i < start + length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN c ON c.r = d.r""",
    "email_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email FROM documents",
    "license_base_places": f"""WITH w AS (SELECT doc_id, {_LICENSE_WORDS} AS words FROM documents), i AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), p AS ({_PHRASES})
SELECT w.doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, count(pos) AS n_base, CAST(min(pos) AS BIGINT) AS first_word, CAST(max(pos) AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS base_labels FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY w.doc_id""",
}
