"""Registered queries of the filter audit, the periodic runs and the repeated passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.llm import audit, runs, substring
from blendscope.llm.queries import query
from blendscope.llm.shared import WORD, tables

SPLIT = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"

AUDIT = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {SPLIT.format('text')} AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
f AS (
  SELECT part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least_id, false)::INT AS m,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM d),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || letter, used + bit FROM o, l WHERE used & bit = 0),
s AS (
  SELECT o AS filter_order, k AS step, bit,
         (SELECT coalesce(sum(b.bit), 0) FROM l b WHERE strpos(o, b.letter) < k) AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS k) JOIN l ON true WHERE len(o) = 5 AND letter = o[k]),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (m & (before + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & bit > 0 AND m & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (m & bit > 0 AND m & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER (m & bit > 0 AND m & before = 0), 0) AS good_lost,
    coalesce(sum(x) FILTER (m & bit > 0 AND m & before = 0), 0) AS toxic_lost
  FROM c, (SELECT filter_order, step, bit, before::INT AS before FROM s) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


@query("op11_filter_audit", AUDIT)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, in every source."""
    read = tables(spark, sf_dir)
    return audit.audit_filters(read("documents").select("doc_id", "text", "source"), read("labels")).drop("letter")


#: crc32 of the decimal id, bit by bit: a byte is mixed in, then each -1 shifts once.
CRC = """xor(list_reduce(list_prepend(4294967295, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
#: Powers of two up to a quarter of the longest text that the SQL can treat (262,143 words).
LEVELS = 16
#: Hashes of 2^j words by doubling; a run of period q (2^j <= q < 2^(j+1)) repeats the 2^j words at a multiple of 2^j.
LEVEL_SQL = ",\n".join(
    f"l{j + 1} AS (SELECT * FROM (SELECT id, i, hash(h, lead(h, {1 << j}) OVER (PARTITION BY id ORDER BY i)) AS h, lead(h, {1 << j}) OVER (PARTITION BY id ORDER BY i) AS e FROM l{j}) WHERE e IS NOT NULL)"
    for j in range(LEVELS - 1))
LAG_SQL = " UNION ".join(
    f"SELECT a.id, b.i - a.i AS q FROM l{j} a JOIN l{j} b ON a.id = b.id AND a.h = b.h WHERE a.i % {1 << j} = 0 AND b.i - a.i >= {1 << j} AND b.i - a.i < {2 << j}"
    for j in range(LEVELS))
RUNS = f"""
WITH o AS (SELECT row_number() OVER () AS id, doc_id, {SPLIT.format('text')} AS w, {CRC} AS crc FROM documents),
p AS (SELECT *, len(w) AS n, crc // 10 AS g FROM o),
t AS (
  SELECT id, doc_id, n, CASE WHEN crc % 10 = 0 AND n > 0 THEN
    [w[CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1] FOR i IN range(n)] ELSE w END AS w FROM p),
l0 AS (SELECT id, unnest(range(n)) AS i, unnest(w) AS word, hash(unnest(w)) AS h FROM t),
{LEVEL_SQL},
lag AS ({LAG_SQL}),
hit AS (SELECT lag.id, q, x.i, x.i - row_number() OVER (PARTITION BY lag.id, q ORDER BY x.i) AS island
  FROM lag JOIN l0 x ON x.id = lag.id JOIN l0 y ON y.id = lag.id AND y.i = x.i + q AND y.word = x.word),
stretch AS (SELECT id, q, min(i) AS s, count(*) + q AS len FROM hit GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch a WHERE NOT EXISTS (
  SELECT 1 FROM stretch b WHERE b.id = a.id AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
gone AS (SELECT DISTINCT id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT l0.id, string_agg(word, ' ' ORDER BY l0.i) AS text FROM l0 ANTI JOIN gone ON gone.id = l0.id AND gone.i = l0.i GROUP BY l0.id),
best AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
  arg_min((s, len, q), (-len, s, q)) AS b FROM run GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period,
       (1000 * b[2] // b[3])::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN best ON best.id = t.id LEFT JOIN kept ON kept.id = t.id
"""


@query("op12_periodic_runs", RUNS)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; a tenth of the documents is first made to repeat a block of its words."""
    found = runs.collapse_runs(planted(tables(spark, sf_dir)("documents").select("doc_id", "text")))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(1))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs``; where crc32 of the id is a multiple of 10, the words from a place on repeat a block of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    chosen = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    placed = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(
        "words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1))
    return placed.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {SPLIT.format('text')} AS w FROM documents),
v AS (SELECT id, doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 18)) AS k FROM d)),
again AS (SELECT id, k FROM v QUALIFY (doc_id, k) > min((doc_id, k)) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT id, unnest(range(k, k + 20)) AS i FROM again),
word AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT word.id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (id, i) GROUP BY word.id),
lost AS (SELECT id, count(*) AS n FROM gone GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.id = d.id LEFT JOIN lost ON lost.id = d.id
"""


@query("op13_repeated_passages", REPEATS)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that begin earlier in the corpus."""
    docs = tables(spark, sf_dir)("documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
