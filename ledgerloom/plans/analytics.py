"""Queries of features, evaluation, feedback, key-value tables, graphs, usage logs and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions import ids, paths, text
from ledgerloom.operators import features, feedback, graph, kv, validation
from ledgerloom.plans.catalog import CTE, files
from ledgerloom.plans.scalars import _CASCADE_SQL, _COMPANY_SQL, _EXT, _EXT_SQL, _PEOPLE_SQL, _UNIQUE_SQL, LABELS_SQL, TOKENS_SQL, cascade, company_names, extension_class, name_patterns, people_names
from ledgerloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = CTE + f", tok AS (SELECT id, schema_type, unnest({TOKENS_SQL}) AS token FROM cur WHERE filename IS NOT NULL)\n"


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).where("filename is not null").select("id", "schema_type", F.explode(paths.tokens(F.col("filename"))).alias("token"))


@query(_TOK + "SELECT token, n, index FROM (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS index FROM tok GROUP BY token HAVING count(*) >= 2) UNION ALL VALUES ('<PAD>', 0, 0), ('<UNK>', 0, 1)")
def win_vocab_rank(s, d):
    return features.vocabulary(s, _tokens(s, d), 2)


@query("SELECT schema_type, row_number() OVER (ORDER BY schema_type) - 1 AS index FROM (SELECT DISTINCT schema_type FROM files WHERE schema_type IS NOT NULL)")
def win_label_encode(s, d):
    return features.label_index(table(s, d, "files"), "schema_type")


@query(
    CTE
    + "SELECT id, CASE WHEN row_number() OVER (PARTITION BY schema_type ORDER BY md5('42|' || id), id) <= floor(count(*) OVER (PARTITION BY schema_type) * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS part FROM cur"
)
def win_stratified_split(s, d):
    return features.stratified_split(s, files(s, d).select("id", "schema_type"), "schema_type", "id", 0.2, 42).select("id", "part")


@query(CTE + f"SELECT id, length(filename) AS name_length, {_EXT_SQL} AS class, len({TOKENS_SQL}) AS tokens, length(original_path) - length(replace(original_path, '/', '')) AS depth, image_width IS NOT NULL AS is_image, coalesce(extracted_text_length, 0) > 0 AS has_text FROM cur")
def feat_extract(s, d):
    n = F.col("filename")
    return files(s, d).select("id", F.length(n).alias("name_length"), extension_class(F.col("file_extension")).alias("class"), F.when(n.isNotNull(), F.size(paths.tokens(n))).alias("tokens"), paths.depth(F.col("original_path")).alias("depth"), F.col("image_width").isNotNull().alias("is_image"), (F.coalesce("extracted_text_length", F.lit(0)) > 0).alias("has_text"))


@query(_TOK + "SELECT token, count(*) AS n, count(DISTINCT id) AS files FROM tok GROUP BY 1 ORDER BY n DESC, token LIMIT 30")
def agg_dataset_tokens(s, d):
    return _tokens(s, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("files")).orderBy(F.desc("n"), "token").limit(30)


_DOCS = ", ".join(f"'.{e}'" for e in ("pdf", "doc", "docx", "rtf", "odt", "txt"))
_STATS_SQL = (
    CTE
    + f"SELECT 'category' AS stat, coalesce(schema_type, 'uncategorized') AS key, count(*) AS n FROM cur GROUP BY 2"
    + " UNION ALL (SELECT 'subcategory', coalesce(mime_type, 'none') AS key, count(*) AS n FROM cur GROUP BY 2 ORDER BY n DESC, key LIMIT 20)"
    + " UNION ALL (SELECT 'extension', coalesce(lower(file_extension), '') AS key, count(*) AS n FROM cur GROUP BY 2 ORDER BY n DESC, key LIMIT 20)"
    + " UNION ALL SELECT 'pattern', 'screenshots', count(*) FILTER (WHERE regexp_matches(lower(filename), 'screenshot|bildschirmfoto')) FROM cur UNION ALL SELECT 'pattern', 'game assets', count(*) FILTER (WHERE regexp_matches(lower(filename), 'sprite|tile|frame')) FROM cur"
    + f" UNION ALL SELECT 'pattern', 'documents', count(*) FILTER (WHERE lower(file_extension) IN ({_DOCS})) FROM cur"
    + " UNION ALL SELECT 'metadata', 'text', count(*) FILTER (WHERE extracted_text_length > 0) FROM cur UNION ALL SELECT 'metadata', 'time', count(created_at) FROM cur UNION ALL SELECT 'metadata', 'size', count(image_width) FROM cur"
    + " UNION ALL SELECT 'filename', 'mean length x 100', round(100 * avg(length(filename)))::BIGINT FROM cur"
)


@query(_STATS_SQL)
def agg_dataset_stats(s, d):
    """Distributions, counts of name patterns and of metadata, mean length of names; words are counted by agg_dataset_tokens."""
    f = files(s, d)
    n = F.count(F.lit(1)).alias("n")
    by = lambda stat, key: f.groupBy(key.alias("key")).agg(n).select(F.lit(stat).alias("stat"), "key", "n")
    top = lambda df: df.orderBy(F.desc("n"), "key").limit(20)
    low, ext = F.lower("filename"), F.lower("file_extension")
    flags = {
        ("pattern", "screenshots"): F.count_if(low.rlike("screenshot|bildschirmfoto")), ("pattern", "game assets"): F.count_if(low.rlike("sprite|tile|frame")), ("pattern", "documents"): F.count_if(ext.isin(".pdf", ".doc", ".docx", ".rtf", ".odt", ".txt")),
        ("metadata", "text"): F.count_if(F.col("extracted_text_length") > 0), ("metadata", "time"): F.count("created_at"), ("metadata", "size"): F.count("image_width"), ("filename", "mean length x 100"): F.round(100 * F.avg(F.length("filename"))).cast("bigint"),
    }
    one = f.agg(F.array(*[F.struct(F.lit(a).alias("stat"), F.lit(b).alias("key"), c.alias("n")) for (a, b), c in flags.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return by("category", F.coalesce("schema_type", F.lit("uncategorized"))).unionByName(top(by("subcategory", F.coalesce("mime_type", F.lit("none"))))).unionByName(top(by("extension", F.coalesce(ext, F.lit(""))))).unionByName(one)


_KNOWN_EXT = ", ".join(f"'{e}'" for e in _EXT)


@query(
    CTE
    + f", q AS (SELECT count(*) AS total, count(*) FILTER (WHERE schema_type IS NULL OR schema_type = 'uncategorized') AS uncategorized, count(*) FILTER (WHERE coalesce(filename, '') = '') AS unnamed, count(*) FILTER (WHERE lower(file_extension) <> '' AND lower(file_extension) NOT IN ({_KNOWN_EXT})) AS unknown_extension FROM cur), dup AS (SELECT count(*) AS duplicate_names FROM (SELECT filename FROM cur WHERE filename <> '' GROUP BY 1 HAVING count(*) > 1))"
    + " SELECT *, round(greatest(0.0, 100 - (uncategorized * 0.5 + unnamed * 1.0 + duplicate_names * 0.1 + unknown_extension * 0.05) * 100 / total), 2) AS score FROM q, dup"
)
def agg_quality(s, d):
    """Missing classes, empty and repeated names, unknown extensions, and a score of 100 less what they weigh."""
    f = files(s, d)
    ext = F.lower("file_extension")
    c = f.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("schema_type").isNull() | (F.col("schema_type") == "uncategorized")).alias("uncategorized"), F.count_if(F.coalesce("filename", F.lit("")) == "").alias("unnamed"), F.count_if((ext != "") & ~ext.isin(*_EXT)).alias("unknown_extension"))
    dup = f.where("filename <> ''").groupBy("filename").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_names"))
    # two single rows side by side
    both = c.withColumn("k", F.lit(1)).join(dup.withColumn("k", F.lit(1)), "k").drop("k")
    lost = F.col("uncategorized") * 0.5 + F.col("unnamed") * 1.0 + F.col("duplicate_names") * 0.1 + F.col("unknown_extension") * 0.05
    return both.withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - F.try_divide(lost * 100, F.col("total"))), 2))


_PRED = CTE + ", pair AS (SELECT coalesce(schema_type, 'none') AS actual, CASE WHEN starts_with(mime_type, 'image/') THEN 'ImageObject' WHEN starts_with(mime_type, 'audio/') THEN 'AudioObject' WHEN starts_with(mime_type, 'video/') THEN 'VideoObject' ELSE 'DigitalDocument' END AS predicted FROM cur)\n"


def _pairs(s, d) -> DataFrame:
    m = F.col("mime_type")
    rules = [(m.startswith("image/"), F.lit("ImageObject")), (m.startswith("audio/"), F.lit("AudioObject")), (m.startswith("video/"), F.lit("VideoObject"))]
    return files(s, d).select(F.coalesce("schema_type", F.lit("none")).alias("actual"), text.first_match(rules, F.lit("DigitalDocument")).alias("predicted"))


@query(_PRED + "SELECT actual, predicted, count(*) AS n FROM pair GROUP BY 1, 2")
def agg_confusion(s, d):
    return features.confusion(_pairs(s, d))


@query(
    _PRED
    + ", k AS (SELECT actual AS class FROM pair UNION SELECT predicted FROM pair), c AS (SELECT class, (SELECT count(*) FROM pair WHERE actual = class) AS support, (SELECT count(*) FROM pair WHERE predicted = class) AS pred, (SELECT count(*) FROM pair WHERE actual = class AND predicted = class) AS tp FROM k), m AS (SELECT class, support, coalesce(tp / nullif(pred, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c)"
    + " SELECT class, support, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m"
)
def agg_prf(s, d):
    return features.scores(_pairs(s, d))


@query(CTE + f"SELECT count(*) AS n, round(avg((coalesce(schema_type, 'none') = CASE WHEN starts_with(mime_type, 'image/') THEN 'ImageObject' WHEN starts_with(mime_type, 'audio/') THEN 'AudioObject' WHEN starts_with(mime_type, 'video/') THEN 'VideoObject' ELSE 'DigitalDocument' END)::INT), 6) AS accuracy, round(avg((mime_type IS NOT NULL AND lower(file_extension) = '.' || split_part(mime_type, '/', 2))::INT), 6) AS sub_accuracy, round(avg(CASE WHEN mime_type IS NULL THEN 0.5 ELSE 0.9 END), 6) AS confidence FROM cur")
def agg_accuracy(s, d):
    """Shares of right classes and of right finer classes, and the mean confidence, in one pass."""
    m = F.col("mime_type")
    rules = [(m.startswith("image/"), F.lit("ImageObject")), (m.startswith("audio/"), F.lit("AudioObject")), (m.startswith("video/"), F.lit("VideoObject"))]
    right = F.coalesce("schema_type", F.lit("none")) == text.first_match(rules, F.lit("DigitalDocument"))
    finer = F.coalesce(F.lower("file_extension") == F.concat(F.lit("."), F.split_part(m, F.lit("/"), F.lit(2))), F.lit(False))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return files(s, d).agg(F.count(F.lit(1)).alias("n"), mean(right.cast("int"), "accuracy"), mean(finer.cast("int"), "sub_accuracy"), mean(F.when(m.isNull(), 0.5).otherwise(0.9), "confidence"))


@query(_PRED + "SELECT actual, predicted, count(*) AS n FROM pair WHERE actual <> predicted GROUP BY 1, 2 ORDER BY n DESC, actual, predicted LIMIT 10")
def agg_misclass_top10(s, d):
    return features.confusion(_pairs(s, d)).where("actual <> predicted").orderBy(F.desc("n"), "actual", "predicted").limit(10)


_LOG = CTE + f", log AS (SELECT id, content_hash AS hash, db_updated_at AS seen, schema_type AS category, mime_type AS mime, {LABELS_SQL} AS patterns FROM cur WHERE schema_type IS NOT NULL), votes AS (SELECT pattern, category, count(*) AS votes FROM (SELECT unnest(patterns) AS pattern, category FROM log) GROUP BY 1, 2)\n"


def _log(s, d) -> DataFrame:
    f = files(s, d).where("schema_type is not null")
    return f.select("id", F.col("content_hash").alias("hash"), F.col("db_updated_at").alias("at"), F.col("schema_type").alias("category"), F.col("mime_type").alias("mime"), name_patterns(F.col("filename")).alias("patterns"))


@query(_LOG + "SELECT 'category' AS what, pattern, category AS value, votes FROM votes UNION ALL SELECT 'subcategory', pattern, mime, count(*) FROM (SELECT mime, unnest(patterns) AS pattern FROM log) GROUP BY 2, 3")
def agg_learned(s, d):
    """Votes of patterns for categories and for finer classes."""
    log = _log(s, d)
    votes = lambda df, what: feedback.pattern_votes(df).select(F.lit(what).alias("what"), "pattern", F.col("category").alias("value"), "votes")
    return votes(log, "category").unionByName(votes(log.drop("category").withColumnRenamed("mime", "category"), "subcategory"))


@query(_LOG + ", t AS (SELECT pattern, sum(votes) AS total, max(votes) AS best FROM votes GROUP BY 1) SELECT t.pattern, min(v.category) AS category, total::BIGINT AS total, round(best / total, 4) AS confidence FROM t JOIN votes v ON v.pattern = t.pattern AND v.votes = best WHERE total >= 3 AND best / total >= 0.7 GROUP BY t.pattern, total, best")
def agg_rules(s, d):
    return feedback.rules(feedback.pattern_votes(_log(s, d)), 3, 0.7)


@query(
    _LOG
    + f", r AS (SELECT id, {_CASCADE_SQL} AS category, unnest({LABELS_SQL}) AS pattern FROM cur), e AS (SELECT r.id, r.category, v.category AS into_, sum(votes) AS votes FROM r JOIN votes v USING (pattern) GROUP BY 1, 2, 3), b AS (SELECT id, category, sum(votes) AS total, max(votes) AS best FROM e GROUP BY 1, 2)"
    + " SELECT b.id, b.category, min(e.into_) AS suggested, round(best / total, 4) AS confidence FROM b JOIN e ON e.id = b.id AND e.votes = best WHERE best / total >= 0.6 GROUP BY b.id, b.category, best, total HAVING min(e.into_) <> b.category"
)
def cls_feedback_suggest(s, d):
    """jn_pattern_votes: the category that learned patterns of the name vote for."""
    rows = files(s, d).select("id", cascade().alias("category"), name_patterns(F.col("filename")).alias("patterns"))
    return feedback.suggestions(rows, feedback.pattern_votes(_log(s, d)), 0.6)


@query(_LOG + ", c AS (SELECT hash, max({'seen': seen, 'id': id, 'category': category}) AS r FROM log WHERE hash IS NOT NULL GROUP BY 1) SELECT u.id, c.r.category AS corrected FROM cur u JOIN c ON c.hash = u.content_hash WHERE u.schema_type IS NULL OR u.schema_type <> c.r.category")
def jn_correction_exact(s, d):
    """Files whose content was labelled otherwise last time."""
    last = feedback.current_corrections(_log(s, d).where("hash is not null").drop("patterns")).select("hash", F.col("category").alias("corrected"))
    return files(s, d).join(last, F.col("content_hash") == F.col("hash")).where("schema_type is null or schema_type <> corrected").select("id", "corrected")


@query(_LOG + f"SELECT 'category' AS what, category AS key, count(*) AS corrections FROM log GROUP BY 2 UNION ALL (SELECT 'mistake', {_CASCADE_SQL} || ' to ' || schema_type AS key, count(*) AS n FROM cur WHERE schema_type IS NOT NULL AND {_CASCADE_SQL} <> schema_type GROUP BY 2 ORDER BY n DESC, key LIMIT 20)")
def agg_corrections(s, d):
    """Corrections per category, and the twenty most frequent mistakes."""
    per = _log(s, d).groupBy(F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("corrections"))
    wrong = files(s, d).where("schema_type is not null").select(cascade().alias("was"), "schema_type").where("was <> schema_type")
    most = wrong.groupBy(F.concat("was", F.lit(" to "), "schema_type").alias("key")).agg(F.count(F.lit(1)).alias("corrections")).orderBy(F.desc("corrections"), "key").limit(20)
    return per.select(F.lit("category").alias("what"), "*").unionByName(most.select(F.lit("mistake").alias("what"), "*"))


_KV = "WITH log AS (SELECT event_type AS namespace, 'user:' || (user_id % 50) AS key, event_id, props AS value, CASE WHEN user_id % 3 = 0 THEN ts + to_minutes(user_id::INT) END AS expires_at FROM events), kv AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY event_id DESC) = 1)\n"
_NOW = "2024-01-30 12:00:00"


def _kv_log(s, d) -> DataFrame:
    e = table(s, d, "events")
    expires = F.when(F.col("user_id") % 3 == 0, (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.col("user_id").cast("int"))).cast("timestamp_ntz"))
    return e.select(F.col("event_type").alias("namespace"), F.concat(F.lit("user:"), (F.col("user_id") % 50).cast("string")).alias("key"), "event_id", F.col("props").alias("value"), expires.alias("expires_at"))


def _kv(s, d) -> DataFrame:
    return kv.last_write(_kv_log(s, d), ["event_id"])


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(_KV + "SELECT namespace, key, value FROM kv")
def kv_set(s, d):
    """kv_set, kv_mset: the last write of each key holds."""
    return _kv(s, d).select("namespace", "key", "value")


@query(_KV + f"SELECT namespace, key, value FROM kv WHERE namespace = 'click' AND key IN ('user:1', 'user:2', 'user:3', 'user:6', 'user:99') AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}')")
def kv_get(s, d):
    """kv_get, kv_exists, flt_kv_in."""
    return kv.get(_kv(s, d), "click", ["user:1", "user:2", "user:3", "user:6", "user:99"], _now()).select("namespace", "key", "value")


@query(_KV + f"SELECT namespace, key, CASE WHEN expires_at IS NULL THEN -1 ELSE greatest(0, floor(epoch(expires_at))::BIGINT - epoch(TIMESTAMP '{_NOW}')::BIGINT) END AS ttl FROM kv")
def kv_ttl(s, d):
    return _kv(s, d).select("namespace", "key", kv.remaining(_now()).alias("ttl"))


@query(_KV + f"SELECT namespace, key FROM kv WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}'")
def kv_cleanup(s, d):
    """kv_delete, flush and cleanup are anti-filters; here of what has expired."""
    return _kv(s, d).where(kv.alive(_now())).select("namespace", "key")


@query("SELECT event_type AS namespace, 'n:' || (user_id % 10) AS key, 100 * (min(user_id % 10) = 3)::INT + count(*) AS value FROM events GROUP BY 1, 2")
def kv_incr(s, d):
    e = table(s, d, "events")
    deltas = e.select(F.col("event_type").alias("namespace"), F.concat(F.lit("n:"), (F.col("user_id") % 10).cast("string")).alias("key"), F.lit(1).alias("delta"))
    start = deltas.where("key = 'n:3'").select("namespace", "key").distinct().withColumn("value", F.lit(100))
    return kv.increment(start, deltas)


@query(_KV + f"SELECT 'user' AS name, namespace, count(*) AS fields, count(*) FILTER (WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}') AS alive FROM kv GROUP BY 2")
def kv_hash(s, d):
    h = kv.hash_fields(_kv(s, d), _now())
    return h.select("name", "namespace", F.size("fields").cast("bigint").alias("fields"), F.size(F.map_filter("fields", lambda k, v: v.isNotNull())).cast("bigint").alias("alive"))


@query(_KV + "SELECT namespace, key FROM kv WHERE key ILIKE 'user:1_'")
def kv_keys(s, d):
    from ledgerloom.operators.catalog import glob_filter

    return glob_filter(_kv(s, d).select("namespace", "key"), "key", "USER:1?")


@query(_KV + f"SELECT namespace, count(*) AS keys, count(*) FILTER (WHERE expires_at < TIMESTAMP '{_NOW}') AS expired FROM kv GROUP BY 1")
def agg_kv_info(s, d):
    return _kv(s, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("expires_at") < _now()).alias("expired"))


_USE = "WITH use AS (SELECT event_type AS feature, date_trunc('day', ts) AS day, (value / 1000)::DECIMAL(18, 6) AS cost, value / 100 AS seconds, event_id % 10 <> 0 AS ok, event_id, CASE WHEN event_id % 10 = 0 THEN 'E' || event_id % 4 END AS error FROM events)\n"


def _usage(s, d) -> DataFrame:
    v = F.col("value")
    failed = F.col("event_id") % 10 == 0
    return table(s, d, "events").select(F.col("event_type").alias("feature"), (v / 1000).cast("decimal(18,6)").alias("cost"), (v / 100).cast("decimal(18,6)").alias("seconds"), (~failed).alias("ok"), "event_id", F.when(failed, F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string"))).alias("error"))


@query(
    _USE
    + "SELECT coalesce(feature, 'total') AS feature, count(*) AS calls, round(sum(cost), 4)::DOUBLE AS cost, round(sum(seconds::DECIMAL(18,6)), 4)::DOUBLE AS seconds, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS failed FROM use GROUP BY ROLLUP (feature)"
)
def agg_cost_by_feature(s, d):
    """Per feature and in total, in one rollup."""
    return _usage(s, d).rollup("feature").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 4).cast("double").alias("cost"), F.round(F.sum("seconds"), 4).cast("double").alias("seconds"), F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("failed")).withColumn("feature", F.coalesce("feature", F.lit("total")))


@query(_USE + "SELECT error, count(*) AS n, round(100.0 * count(*) / greatest((SELECT count(*) FROM use), 1), 4) AS rate FROM use WHERE error IS NOT NULL GROUP BY 1")
def agg_error_types(s, d):
    u = _usage(s, d)
    return u.groupBy("error").agg(F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(100.0 * F.col("n") / F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1)), 4)).where("error is not null")


@query(_USE + "SELECT feature, round(sum(seconds::DECIMAL(18,6)), 4)::DOUBLE AS seconds, count(*) FILTER (WHERE ok) AS good, arg_max(error, event_id) FILTER (WHERE error IS NOT NULL) AS last_error FROM use GROUP BY 1")
def agg_tracker(s, d):
    return _usage(s, d).groupBy("feature").agg(F.round(F.sum("seconds"), 4).cast("double").alias("seconds"), F.count_if("ok").alias("good"), F.max(F.when(F.col("error").isNotNull(), F.struct("event_id", "error"))).alias("e")).select("feature", "seconds", "good", F.col("e.error").alias("last_error"))


@query("SELECT event_id, event_type, unit FROM events JOIN (VALUES ('click', 'call'), ('view', 'page'), ('purchase', 'order')) c(name, unit) ON event_type = name")
def jn_config_dim(s, d):
    """A usage log with a fixed dimension of a few rows, which is broadcast."""
    dim = s.createDataFrame([("click", "call"), ("view", "page"), ("purchase", "order")], "event_type string, unit string")
    return table(s, d, "events").join(F.broadcast(dim), "event_type").select("event_id", "event_type", "unit")


@query(CTE + f"SELECT id, {_EXT_SQL} AS folder FROM cur WHERE file_extension IS NOT NULL")
def jn_rule_lookup(s, d):
    rules = F.broadcast(s.createDataFrame(list(_EXT.items()), "ext string, folder string"))
    return files(s, d).where("file_extension is not null").join(rules, F.lower("file_extension") == F.col("ext"), "left").select("id", F.coalesce("folder", F.lit("other")).alias("folder"))


_EDGES = "edges AS (SELECT row_number() OVER (ORDER BY id, parent_id) AS edge, id AS source, parent_id AS target FROM categories WHERE parent_id IS NOT NULL)"


def _edges(s, d) -> DataFrame:
    c = table(s, d, "categories").where("parent_id is not null")
    return c.select(F.col("id").alias("edge"), F.col("id").alias("source"), F.col("parent_id").alias("target"), F.lit("CHILD").alias("type"), F.lit(1.0).alias("confidence"))


@query(
    f"WITH RECURSIVE {_EDGES}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges), walk AS (SELECT 1::BIGINT AS id, 0 AS hop UNION SELECT e.b, w.hop + 1 FROM walk w JOIN both_ways e ON e.a = w.id WHERE w.hop < 3)"
    + ", near AS (SELECT id, min(hop) AS hop FROM walk GROUP BY 1) SELECT n.id, n.hop, CASE WHEN n.hop > 0 THEN (SELECT min(e.a) FROM both_ways e JOIN near p ON p.id = e.a AND p.hop = n.hop - 1 WHERE e.b = n.id) END AS via FROM near n"
)
def grf_bfs(s, d):
    """jn_graph_step: three steps round category 1."""
    return graph.breadth_first(s, _edges(s, d), s.createDataFrame([(1,)], "id bigint"), 3).select("id", "hop", "via")


@query(
    "WITH RECURSIVE tree AS (SELECT id, name, 0 AS depth, name AS path, id AS root FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, c.name, t.depth + 1, t.path || '/' || c.name, t.root FROM categories c JOIN tree t ON c.parent_id = t.id) SELECT id, depth::BIGINT AS depth, path, root FROM tree"
)
def grf_category_tree(s, d):
    """Paths from the root of every category by pointer doubling over parent links."""
    from ledgerloom.operators.hierarchy import hierarchy

    c = table(s, d, "categories")
    names = c.select("id", "name")
    tree = hierarchy(s, c.select(F.lit("c").alias("kind"), "id", F.col("parent_id").alias("parent")), paths=True).nodes
    steps = tree.select("id", "depth", "root", F.posexplode(F.reverse(F.concat(F.array("id"), "path"))).alias("pos", "at")).join(names.withColumnRenamed("id", "at"), "at")
    return steps.groupBy("id", "depth", "root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "/").alias("path"))


@query("SELECT category_id, count(*) AS links, count(DISTINCT file_id) AS files FROM file_categories WHERE category_id IS NOT NULL GROUP BY 1")
def grf_degree(s, d):
    return table(s, d, "file_categories").where("category_id is not null").groupBy("category_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("file_id").alias("files"))


_MAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
_VAL = (
    CTE
    + r""", v AS (SELECT id, (coalesce(name, '') = '')::INT + (coalesce(email, '') = '')::INT + coalesce((NOT regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$'))::INT, 0) AS errors,
  coalesce((last_seen < first_seen)::INT, 0) AS warnings, (role IS NULL)::INT AS infos FROM people)
"""
)


def _validated(s, d) -> DataFrame:
    checks = [*validation.required(["name", "email"]), *validation.formatted({"email": _MAIL}), validation.message(F.col("last_seen") < F.col("first_seen"), "warning", "order", "last_seen"), *validation.recommended(["role"])]
    return validation.validated(table(s, d, "people"), checks)


@query(_VAL + "SELECT id, errors, warnings, errors = 0 AS is_valid, errors + warnings + infos AS messages FROM v")
def val_report(s, d):
    """val_structure to val_report: all checks of a row in one projection."""
    return _validated(s, d).select("id", "errors", "warnings", "is_valid", F.size("messages").alias("messages"))


@query(_VAL + "SELECT count(*) AS total, count(*) FILTER (WHERE errors = 0) AS valid, count(*) FILTER (WHERE errors > 0) AS invalid, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, round(100.0 * count(*) FILTER (WHERE errors = 0) / count(*), 4) AS valid_percent FROM v")
def agg_validation_summary(s, d):
    """val_batch."""
    return validation.summary(_validated(s, d))


@query("SELECT m.property, m.level, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(name, '') = '' THEN {'property': 'name', 'level': 'error'} END, CASE WHEN coalesce(email, '') = '' THEN {'property': 'email', 'level': 'error'} END, CASE WHEN role IS NULL THEN {'property': 'role', 'level': 'info'} END], lambda x: x IS NOT NULL)) AS m FROM people) GROUP BY 1, 2")
def val_required(s, d):
    """val_required and val_recommended, counted."""
    v = validation.validated(table(s, d, "people"), [*validation.required(["name", "email"]), *validation.recommended(["role"])])
    return v.select(F.explode("messages").alias("m")).groupBy("m.property", "m.level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(schema_type, 'Unknown') AS type, count(*) AS n FROM files GROUP BY 1")
def agg_registry_stats(s, d):
    return table(s, d, "files").groupBy(F.coalesce("schema_type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    CTE
    + """SELECT id, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$."@type"') AS type, json_extract_string(j, '$.contentSize') AS size, json_extract_string(j, '$."@id"') AS iri FROM (SELECT id, to_json({'@context': 'https://schema.org', '@type': coalesce(schema_type, 'DigitalDocument'), '@id': 'urn:sha256:' || sha256(original_path), 'name': filename, 'contentSize': file_size}) AS j FROM cur)"""
)
def fn_jsonld_doc(s, d):
    """Documents as JSON-LD texts and back; null properties are left out of the text."""
    f = files(s, d)
    doc = jsonld(f)
    j = F.col("j")
    return f.select("id", doc.alias("j")).select("id", F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.@type").alias("type"), F.get_json_object(j, "$.contentSize").alias("size"), F.get_json_object(j, "$.@id").alias("iri"))


def jsonld(f: DataFrame):
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.coalesce("schema_type", F.lit("DigitalDocument")).alias("@type"), ids.file_iri(F.col("original_path")).alias("@id"), F.col("filename").alias("name"),
            F.col("file_size").alias("contentSize"), F.col("mime_type").alias("encodingFormat"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("dateCreated"), F.col("image_width").alias("width"), F.col("image_height").alias("height"),
        )
    )


@query(CTE + "SELECT id, coalesce(schema_type, 'DigitalDocument') AS type FROM cur WHERE coalesce(schema_type, 'DigitalDocument') = 'ImageObject' AND contains(lower(filename), 'tile')")
def flt_registry_search(s, d):
    """flt_registry_type and flt_registry_search over JSON-LD texts."""
    f = files(s, d)
    r = f.select("id", jsonld(f).alias("j")).select("id", F.get_json_object("j", "$.@type").alias("type"), F.get_json_object("j", "$.name").alias("name"))
    return r.where((F.col("type") == "ImageObject") & F.lower("name").contains("tile")).select("id", "type")


@query("SELECT target_canonical_id AS id, CASE WHEN count(DISTINCT x) = 1 THEN min(x) ELSE '[' || string_agg(DISTINCT x, ',' ORDER BY x) || ']' END AS same_as FROM (SELECT target_canonical_id, unnest(from_json(source_canonical_ids, '[\"VARCHAR\"]')) AS x FROM merge_events WHERE json_valid(source_canonical_ids)) WHERE target_canonical_id IS NOT NULL AND x IS NOT NULL GROUP BY 1")
def fn_sameas(s, d):
    """owl:sameAs: one value as it is, several as a list."""
    e = table(s, d, "merge_events").where("target_canonical_id is not null").select(F.col("target_canonical_id").alias("id"), F.explode(F.from_json("source_canonical_ids", "array<string>")).alias("x")).where("x is not null").distinct()
    g = e.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return g.select("id", F.when(F.size("xs") == 1, F.col("xs")[0]).otherwise(F.concat(F.lit("["), F.array_join("xs", ","), F.lit("]"))).alias("same_as"))


_INDEX_SQL = (
    f"WITH e AS (SELECT doc_id, 'person' AS kind, unnest({_UNIQUE_SQL.format('l')}) AS name FROM {_PEOPLE_SQL} UNION ALL SELECT doc_id, 'company', unnest({_UNIQUE_SQL.format('l')}) FROM {_COMPANY_SQL})\n"
)


@query(_INDEX_SQL + "SELECT kind, name, count(*) AS documents, array_to_string(list_sort(list(doc_id))[:3], ',') AS first FROM e GROUP BY 1, 2")
def agg_people_companies(s, d):
    """An inverted index of the persons and firms named in texts, with the number of documents and the first three; the three smallest by a window with a limit."""
    t = table(s, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("person").alias("kind"), people_names(F.col("text")).alias("names")), F.struct(F.lit("company").alias("kind"), company_names(F.col("text")).alias("names")))).alias("e"))
    each = t.select("doc_id", "e.kind", F.explode("e.names").alias("name"))
    n = each.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("documents"))
    three = each.withColumn("r", F.row_number().over(W.partitionBy("kind", "name").orderBy("doc_id"))).where("r <= 3").groupBy("kind", "name").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first"))
    return n.join(three, ["kind", "name"])


@query(_INDEX_SQL + "SELECT doc_id, count(*) FILTER (WHERE kind = 'person') AS persons, count(*) FILTER (WHERE kind = 'company') AS firms FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'person') > 1 ORDER BY persons DESC, doc_id LIMIT 10")
def agg_most_people(s, d):
    """The ten documents with most persons, of those with more than one."""
    n = table(s, d, "documents").select("doc_id", F.size(people_names(F.col("text"))).cast("bigint").alias("persons"), F.size(company_names(F.col("text"))).cast("bigint").alias("firms"))
    return n.where("persons > 1").orderBy(F.desc("persons"), "doc_id").limit(10)
