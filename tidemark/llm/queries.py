"""One query for each operator of this package, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import capfilter, decontam, filteraudit, licenses, linecrf, linedrop, mixing, pathjoin, periods, ppm, repeats, sharding, urlrules
from tidemark.llm.stage import settle

#: Shards of op8.
SHARDS = 24
#: The least score of a document that is kept.
QUALITY = 0.3
RULES = (
    urlrules.Rule("allow", "com", "/"),
    urlrules.Rule("block", "example.com", "/en/"),
    urlrules.Rule("allow", "www.example.com", "/en/"),
    urlrules.Rule("block", "net", "/es/"),
    urlrules.Rule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32 of the document id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = settle(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    return mixing.taken_words(mixing.mix(sizes)).drop("source")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathjoin.join(table(spark, sf_dir, "documents"))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def quality_field(docs: DataFrame, labels: DataFrame) -> linecrf.Field | None:
    """A field that has seen no label of the held-out fold."""
    return linecrf.fit(docs, labels.filter(fold(5) != 0))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = linecrf.score(docs, quality_field(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(files)


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.lit("key").alias("law")
    )
    now = sharding.assign(docs, "doc_id", [1.0] * SHARDS)
    grown = sharding.assign(now, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.with_slots(grown, "doc_id", ("text_crc32", "size"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.link(table(spark, sf_dir, "embeddings"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linedrop.drop(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", "words_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """The documents with the words that op13's contract repeats in a tenth of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, g = F.size("words"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    some = docs.withColumn("words", F.when(h % 10 == 0, words))
    return some.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.collapse(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    # Runs come by start, then period, so the first of equals stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x) > 0, y).otherwise(x))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return docs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_ngram_jaccard_join, op3_ppm_score, op4_decontaminate, op5_line_quality, op6_url_rules, op7_license_scan, op8_rendezvous_shards, op9_cap_filters, op10_line_templates, op11_filter_audit, op12_repeated_bytes, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in own}


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SOLID = r"'[^\x20\x09-\x0D]+'"


def _op1() -> str:
    primes = ", ".join(map(str, mixing.MULTIPLIERS))
    hex_of = lambda salt: f"('0x' || substr(md5('{salt}' || label), 1, 12))::BIGINT"
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {SOLID})), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS k FROM d GROUP BY source),
capped AS (SELECT *, (3.0 * ss)::DOUBLE AS cap, (k % 3 + 1)::DOUBLE AS weight FROM per),
leveled AS (
  SELECT *, cap / weight AS ratio,
    ((sum(ss) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM capped WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM leveled WHERE level * weight <= cap ORDER BY ratio, k LIMIT 1),
plan AS (
  SELECT source, ss, least(cap, (SELECT level FROM chosen) * weight) AS target, greatest(1, least(128, floor(ss / 256.0)))::BIGINT AS bs FROM leveled),
quota AS (SELECT source, ceil(ss::DOUBLE / bs)::BIGINT AS n, floor(target * ceil(ss::DOUBLE / bs) / ss + 0.5)::BIGINT AS q FROM plan WHERE ss > 0),
slot AS (SELECT source, n, floor(g / n)::BIGINT AS epoch, (g % n) AS i, '0:' || coalesce(source, chr(0)) || ':' || floor(g / n)::BIGINT AS label FROM quota, LATERAL (SELECT unnest(range(q)) AS g)),
uses AS (
  SELECT source, ((i::HUGEINT * ([{primes}][1 + ({hex_of("a")} % 16)] % n) + ({hex_of("b")} % n)) % n)::BIGINT AS block, count(*) AS times
  FROM slot GROUP BY ALL),
laid AS (
  SELECT doc_id, d.source, size, row_number() OVER w AS r, (sum(size) OVER w - size)::BIGINT AS pos
  FROM d WINDOW w AS (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
piece AS (
  SELECT l.*, bs, ss, target, unnest(range(floor(pos / bs)::BIGINT, greatest(floor(pos / bs)::BIGINT, floor((pos + size - 1) / bs)::BIGINT) + 1)) AS block
  FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, ss AS source_size, target,
  sum(coalesce(times, 0) * greatest(0, least(pos + size, (piece.block + 1) * bs) - greatest(pos, piece.block * bs)))::BIGINT AS taken
FROM piece LEFT JOIN uses ON uses.source IS NOT DISTINCT FROM piece.source AND uses.block = piece.block
GROUP BY doc_id, piece.source, r, size, ss, target"""


def _op2() -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, {AZ}), {SOLID}) AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE x::DOUBLE / (p.n + q.n - x) >= 0.8),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
per AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(k, 0)::BIGINT AS n_links, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN class ON class.a = doc_id LEFT JOIN per ON per.a = doc_id"""


def _op4() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), {word}), []) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, {AZ}), {word}) AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS size, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS t
  FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS t
  FROM (SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT r, i, dw.size, item FROM dw JOIN bw ON bw.size = dw.size AND bw.t = dw.t),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def _op6() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    return rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {rules}),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {AZ}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (
  SELECT r, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
  FROM p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (r)"""


def _op7() -> str:
    model = licenses.Templates(licenses.standard())
    idf = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(model.idf.items()))
    weak = ", ".join(f"'{k}'" for k in licenses.WEAK)
    unit = ", ".join(f"('{k}', {i}, '{t}', {x!r}::DOUBLE)" for (k, i), u in model.unit.items() for t, x in sorted(u.items()))
    return rf"""
WITH idf(w, x) AS (VALUES {idf}), unit(k, i, w, u) AS (VALUES {unit}),
f AS (
  SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, concat_ws('/', source, lang) AS dir, text FROM documents),
l AS (
  SELECT r, 0 AS kind, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f
  UNION ALL SELECT r, 1, unnest(string_split_regex(text, '{licenses.BLANK}')), generate_subscripts(string_split_regex(text, '{licenses.BLANK}'), 1) FROM f
  UNION ALL SELECT r, 2, text, 1 FROM f),
t AS (
  SELECT r, kind, line, w, count(*) AS tf FROM (
    SELECT r, kind, line, unnest(string_split_regex(regexp_replace(regexp_replace(lower(l), '[^a-z0-9.\-]+', ' ', 'g'), '[.]+( |$)|-+( |$)', ' ', 'g'), ' ')) AS w FROM l) WHERE w <> '' GROUP BY ALL),
v AS (SELECT t.*, tf * coalesce(x, {model.rare!r}::DOUBLE) AS x FROM t LEFT JOIN idf USING (w)),
norm AS (SELECT r, kind, line, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT r, kind, line, k, i, sum(x * u) AS d FROM v JOIN unit USING (w) GROUP BY ALL),
cosine AS (SELECT r, kind, line, k, floor(d / norm * 1e6 + 0.5) / 1e6 AS c FROM dots JOIN norm USING (r, kind, line)),
best AS (SELECT r, kind, line, c, k FROM cosine WHERE c >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY r, kind, line ORDER BY k IN ({weak}), c DESC, k) = 1),
counted AS (SELECT best.*, len(regexp_extract_all(l.l, {SOLID})) AS n FROM best JOIN l USING (r, kind, line)),
kinds AS (SELECT r, kind, sum(n) AS n, min((k IN ({weak}), -c, k)) AS b FROM counted GROUP BY ALL),
own AS (SELECT r, max(n) AS n, min(b)[3] AS license, -(min(b)[2]) AS score FROM kinds GROUP BY r),
marked AS (SELECT f.r, doc_id, path, dir, license, score, n, len(regexp_extract_all(text, {SOLID})) AS words, regexp_matches(regexp_replace(path, '^.*/', ''), '{licenses.NAMED}') AS named FROM f LEFT JOIN own USING (r)),
holds AS (SELECT dir AS up, arg_min(license, (-score, license)) AS license, max(score) AS score FROM marked WHERE license IS NOT NULL AND CASE WHEN license IN ({weak}) THEN named AND n >= {licenses.SHARE} * words ELSE named OR n >= {licenses.SHARE} * words END GROUP BY dir),
near AS (
  SELECT m.dir, arg_max(h.up, length(h.up)) AS up, arg_max(h.license, length(h.up)) AS license, arg_max(h.score, length(h.up)) AS score
  FROM (SELECT DISTINCT dir FROM marked) m JOIN holds h ON m.dir = h.up OR starts_with(m.dir, h.up || '/') GROUP BY m.dir)
SELECT doc_id, path, coalesce(m.license, near.license) AS license, coalesce(m.score, near.score) AS score,
  CASE WHEN m.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN m.license IS NULL THEN up END AS origin_dir
FROM marked m LEFT JOIN near ON near.dir = m.dir"""


def _op9() -> str:
    return """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b, id FROM link UNION SELECT reach.a, link.b, link.id FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(id) AS low FROM reach GROUP BY a), per AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM e LEFT JOIN low ON low.a = r LEFT JOIN per ON per.a = r"""


def _op10() -> str:
    enough = "CASE WHEN n > 50 THEN 2 ELSE 5 END"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS tid, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT tid, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
tok AS (SELECT *, list_transform(regexp_extract_all(translate(l, {AZ}), {SOLID}), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '0' ELSE w END) AS f FROM l),
form AS (SELECT DISTINCT tid, f, len(f)::INT AS n FROM tok WHERE len(f) >= 4),
known AS (SELECT f, n, count(*) AS docs FROM form GROUP BY ALL),
cut AS (SELECT *, greatest(1, most // 2) AS size, CASE WHEN most > 1 THEN 2 ELSE 1 END AS k FROM (SELECT f, n, floor(n * (1 - 0.7::DOUBLE) + 1e-9)::INT AS most FROM known) WHERE most > 0),
piece AS (SELECT *, ((n - {linedrop.LEAD} + size - 1) // size)::INT AS p FROM cut),
way AS (SELECT f, n, size, i, j FROM (SELECT *, unnest(range(p)) AS i FROM piece), LATERAL (SELECT unnest(CASE WHEN least(k, p) = 2 THEN range(i + 1, p) ELSE [i] END) AS j)),
template AS (SELECT f, n, md5(array_to_string(list_transform(range(n), lambda x: CASE WHEN x >= {linedrop.LEAD} AND ((x - {linedrop.LEAD}) // size = i OR (x - {linedrop.LEAD}) // size = j) THEN '' ELSE f[x + 1] END), ' ')) AS key FROM way),
often AS (SELECT key FROM template JOIN form USING (f, n) GROUP BY key, n HAVING count(DISTINCT tid) >= {enough}),
bad AS (SELECT f FROM known WHERE docs >= {enough} UNION SELECT f FROM template WHERE key IN (SELECT key FROM often)),
hit AS (SELECT tid, l, pos, len(f) AS n, f IN (SELECT f FROM bad) AS gone FROM tok),
kept AS (
  SELECT tid, count(*) AS n_lines, sum(gone::INT) AS n_dropped, sum(CASE WHEN gone THEN n ELSE 0 END) AS words, coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left_
  FROM hit GROUP BY tid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(words, 0)::BIGINT AS words_dropped, length(left_)::BIGINT AS n_chars_left, md5(left_) AS text_md5
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN kept USING (tid)"""


def _op11() -> str:
    five = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(filteraudit.LETTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, {SOLID}) AS ws FROM d),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask
  FROM w JOIN first USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, good, bad, count(*) AS n FROM m GROUP BY ALL),
f(c, bit) AS (VALUES {five}),
o AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a, f b, f x, f y, f z WHERE a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * bad ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def _op12() -> str:
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (
  SELECT r, doc_id, b, least(1000, n - 49 - 1000 * b) AS m, substr(h, 2000 * b + 1, 2098) AS h
  FROM (SELECT *, unnest(range(0, (n - 50) // 1000 + 1)) AS b FROM d WHERE n >= 50)),
s AS (SELECT r, doc_id, 1000 * b + i AS i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT *, unnest(range(0, m)) AS i FROM blocks)),
low AS (SELECT k, min(doc_id) AS low FROM s GROUP BY k),
hit AS (SELECT r, i FROM s JOIN low USING (k) WHERE low < doc_id),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER w + 50, true)::INT AS new FROM hit WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
span AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, g),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM span),
kept AS (
  SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS gone, count(*) AS spans
  FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that DuckDB can express.

    None for op3 (a trie with escapes), op5 (a fitted field), op8 and op13 (DuckDB has no crc32): tests compare them with brute
    force.
    """
    return {"op1_mix_sources": _op1(), "op2_ngram_jaccard_join": _op2(), "op4_decontaminate": _op4(), "op6_url_rules": _op6(), "op7_license_scan": _op7(), "op9_cap_filters": _op9(), "op10_line_templates": _op10(), "op11_filter_audit": _op11(), "op12_repeated_bytes": _op12()}
