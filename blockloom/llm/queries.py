"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import WORD
from blockloom.llm.conversation_repair import digests, repaired_turns, repairs, report
from blockloom.llm.importance import BUCKETS, DRAWN_PERCENT, LEAST_WORDS, SCALE, SEED, resampled
from blockloom.llm.line_dedup import line_duplicates
from blockloom.llm.mixing import mixing
from blockloom.llm.near_dedup import near_duplicates
from blockloom.llm.packing import best_fit_packing
from blockloom.llm.preference_chat import preference_pairs, rendered, trained_chars, weaker
from blockloom.llm.prefix_forest import nearest
from blockloom.llm.quality_rules import MAX_REPEAT_PERCENT, MEASURES, MIN_GROUP, MIN_WORDS, SPREADS, quality_rules
from blockloom.llm.secret_scan import BASE_KINDS, of_kinds, scan_secrets, span_text
from blockloom.llm.token_counts import token_counts
from blockloom.llm.toxicity import severity, train
from blockloom.llm.url_filters import LOWER, PATTERNS, UPPER, url_verdicts
from blockloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 fine, 1 of poor quality, 2 toxic. Toxic is what more likely than not has grade 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    model = train(docs, labels.select("doc_id", grade.alias("grade")))
    return severity(docs, model).withColumn("toxic", F.col("grade") == 2)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), text)), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][rank % 3 + 1]::BIGINT AS weight, 2 * source_size AS cap,
    (150 * sum(source_size) OVER ())::BIGINT AS budget FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS capped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight
  FROM w WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - 100 * capped) / (100 * open_weight) AS level FROM o),
g AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM g),
c AS (
  SELECT d.*, e.source_size, e.target, e.rounds, e.target - e.rounds * e.source_size AS extra,
    sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS step
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (rounds + CASE WHEN 2 * upto - step <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query
def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its weaker form."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, weaker(turns))
    digest = [
        column
        for side in ("chosen", "rejected")
        for column in (
            rendered(F.col(side)).alias(side),
            trained_chars(F.col(side)).alias(f"{side}_trained_chars"),
        )
    ]
    return pairs.select("conv_id", "prompt_turns", "prompt", *digest)


ORACLES["op5_preference_chat"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
r AS (
  SELECT conv_id, turn, role, CASE WHEN turn = last AND role = 'assistant'
    THEN array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) // 2], ' ') ELSE text END AS text
  FROM t JOIN l USING (conv_id) WHERE last IS NULL OR turn <= last),
n AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    '<|' || role || '|>' || chr(10) || text || chr(10) AS said,
    CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS trained
  FROM (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM r)),
p AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.pos, r.pos)) AS first
  FROM (FROM n WHERE side = 'c') c FULL JOIN (FROM n WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.pos = r.pos
  WHERE c.said IS DISTINCT FROM r.said GROUP BY 1)
SELECT n.conv_id, min(coalesce(first - 1, same))::INTEGER AS prompt_turns,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (side = 'c' AND pos < coalesce(first, same + 1)), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (side = 'c' AND pos >= first), '') AS chosen,
  coalesce(sum(trained) FILTER (side = 'c' AND pos >= first), 0)::BIGINT AS chosen_trained_chars,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (side = 'r' AND pos >= first), '') AS rejected,
  coalesce(sum(trained) FILTER (side = 'r' AND pos >= first), 0)::BIGINT AS rejected_trained_chars
FROM n LEFT JOIN p USING (conv_id)
  JOIN (SELECT conv_id, count(*) AS same FROM n WHERE side = 'c' GROUP BY 1) z USING (conv_id)
GROUP BY n.conv_id
"""


#: Host rules of the registered query: verdict, host, start of the path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES["op8_url_filters"] = rf"""
WITH r(verdict, host, path) AS (VALUES {", ".join(map(str, URL_RULES))}),
p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p)
SELECT page_id, host, path,
  (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM r
    WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)) AS rule,
  coalesce(
    (SELECT max_by(r.verdict, length(r.host || r.path)) FROM r
      WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)),
    CASE WHEN {" OR ".join(f"regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{p}')" for p, _ in PATTERNS)}
      THEN 'block' ELSE 'allow' END) AS verdict
FROM h
"""


ORACLES["op6_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
x AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS times
  FROM (SELECT rid, i, w[i:i + 4] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM x WHERE times > 1) GROUP BY rid),
l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(list_sum([length(y) FOR y IN w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS (
  {" UNION ALL ".join(
      f"SELECT rid, lang, source, '{name}' AS measure, floor(1000 * {above} / {below})::BIGINT AS value, "
      f"{least} AS least, {both} AS both_sides FROM b WHERE NOT base_failed"
      for name, (below, above, both, least) in MEASURES.items())}),
s AS (
  SELECT *, greatest(length(bin(value)) - 7, 0) AS shift FROM v),
g AS (
  SELECT grouping(lang, source) AS level, lang, source, measure, least, both_sides, shift * 64 + (value >> shift) AS bin, count(*) AS n
  FROM s GROUP BY GROUPING SETS ((lang, source, measure, least, both_sides, shift * 64 + (value >> shift)),
    (lang, measure, least, both_sides, shift * 64 + (value >> shift)), (measure, least, both_sides, shift * 64 + (value >> shift)))),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM g),
q AS (
  SELECT level, lang, source, measure, least, both_sides, max(total) AS total,
    min(CASE WHEN 4 * upto >= total THEN bin END) AS b1, min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS b3
  FROM u GROUP BY ALL),
f AS (
  SELECT level, lang, source, measure, least, both_sides, total,
    (b1 - 64 * greatest(b1 // 64 - 1, 0)) << greatest(b1 // 64 - 1, 0)::INTEGER AS q1,
    (b3 - 64 * greatest(b3 // 64 - 1, 0)) << greatest(b3 // 64 - 1, 0)::INTEGER AS q3 FROM q),
t AS (
  SELECT o.lang, o.source, o.measure, o.least, o.both_sides,
    CASE WHEN o.total >= {MIN_GROUP} THEN o.q1 WHEN m.total >= {MIN_GROUP} THEN m.q1 ELSE a.q1 END AS q1,
    CASE WHEN o.total >= {MIN_GROUP} THEN o.q3 WHEN m.total >= {MIN_GROUP} THEN m.q3 ELSE a.q3 END AS q3
  FROM f o JOIN f m ON m.level = 1 AND m.lang IS NOT DISTINCT FROM o.lang AND m.measure = o.measure
    JOIN f a ON a.level = 3 AND a.measure = o.measure
  WHERE o.level = 0),
k AS (
  SELECT rid, bool_and(value <= q3 + {SPREADS} * greatest(q3 - q1, t.least)
    AND (NOT t.both_sides OR value >= q1 - {SPREADS} * greatest(q3 - q1, t.least))) AS inside
  FROM v JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.measure = t.measure
  GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(inside, true) AS kept
FROM b LEFT JOIN k USING (rid)
"""


ORACLES["op7_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [w] ELSE [w[i:i + 1] FOR i IN range(1, len(w))] END) AS k
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


#: The 256 remainders of CRC-32, by its rule, and the checksum of a text's UTF-8 bytes from them.
CRC_TABLE = """SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(text: str) -> str:
    byte = f"('0x' || substr(hex({text}), 2 * j + 1, 2))::BIGINT"
    return f"""xor(4294967295, list_reduce([4294967295] || [{byte} FOR j IN range(strlen({text}))],
      lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance"] = rf"""
WITH k AS ({CRC_TABLE}),
w AS (
  SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 0 AS target, row_number() OVER () AS rid, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark)),
f AS (
  SELECT target, rid, unnest(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, greatest(len(words), 1))]) AS feature FROM w),
c AS (SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f), k),
n AS (SELECT target, rid, bucket, count(*) AS n FROM f JOIN c USING (feature) GROUP BY ALL),
b AS (
  SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
  FROM n GROUP BY bucket),
a AS (SELECT coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM n),
g AS (
  SELECT bucket, floor({SCALE} * ln(((b.t + 1) * (a.s + {BUCKETS}))::DOUBLE / ((b.s + 1) * (a.t + {BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM b, a),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE target = 0 GROUP BY rid),
d AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m USING (rid) WHERE target = 0),
z AS (SELECT *, weight + floor(-{SCALE} * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
    {DRAWN_PERCENT} * count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () // 100 AS drawn
  FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM r
"""


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = of_kinds(F.col("spans"), BASE_KINDS)
    counts = [F.size(of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that follow from the ids of their rows."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    damage = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return turns.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(role).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repairs(damaged(turns))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    reports, hashes = report(found, "reported"), digests(repaired_turns(found, "hashed"), "hashed")
    out = ids.join(reports, F.col("id").eqNullSafe(F.col("reported")) & F.col("cost").isNotNull(), "left").join(
        hashes, F.col("id").eqNullSafe(F.col("hashed")) & F.col("sha256").isNotNull(), "left"
    )
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: States of the repair's grammar as in the operator: 0 nothing yet, 1 after s, 2 after u, 3 after a.
ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE k AS ({CRC_TABLE}),
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT o.*, {crc32_sql("name")} % 20 AS damage FROM o, k),
d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h)),
p AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM p),
f AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1 WHEN seen > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM y),
s AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
x(state, added, cost, reached, said) AS (VALUES (0, '', 0, 0, ''), (1, '', 0, 1, ''), (2, '', 0, 2, ''), (3, '', 0, 3, ''),
  (0, 'I', 5, 2, chr(10) || 'user:'), (1, 'I', 5, 2, chr(10) || 'user:'), (2, 'I', 5, 3, chr(10) || 'assistant:'), (3, 'I', 5, 2, chr(10) || 'user:'),
  (0, 'II', 10, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 10, 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
e(letter, state, initial, reached, cost) AS (VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0),
  ('K', 2, 'a', 3, 0), ('R', 0, '', 2, 1), ('R', 1, '', 2, 1), ('R', 3, '', 2, 1), ('R', 2, '', 3, 1),
  ('D', 0, '', 0, 2), ('D', 1, '', 1, 2), ('D', 2, '', 2, 2), ('D', 3, '', 3, 2)),
r AS (
  SELECT c, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS said FROM s
  UNION ALL
  SELECT r.c, f.i, e.reached, r.cost + x.cost + e.cost + CASE WHEN fault = 3 AND letter <> 'D' THEN 5 ELSE 0 END AS total,
    audit || added || letter AS letters, r.said || x.said || CASE letter WHEN 'D' THEN '' ELSE chr(10) ||
      CASE letter WHEN 'K' THEN role WHEN 'R' THEN CASE e.reached WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || text END
  FROM r JOIN f ON f.c = r.c AND f.i = r.i + 1 JOIN x ON x.state = r.state
    JOIN e ON e.state = x.reached AND (letter <> 'K' OR e.initial = f.initial) AND (letter = 'D' OR fault IN (0, 3))
  QUALIFY row_number() OVER (PARTITION BY r.c, e.reached ORDER BY total, letters) = 1),
z AS (
  SELECT r.c, r.cost + x.cost AS cost, audit || added AS audit, r.said || x.said AS said
  FROM r JOIN s ON s.c = r.c AND s.n = r.i JOIN x ON x.state = r.state WHERE x.reached IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY r.c ORDER BY r.cost + x.cost, audit || added) = 1)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON z.c = s.c
"""
