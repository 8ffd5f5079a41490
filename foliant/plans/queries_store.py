"""Queries over results, history, statistics, vectors and event streams, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import store
from foliant.plans.queries import Source, query
from foliant.sources import tables
from foliant.streaming import events as streams

ME = 7


@query("", "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_results(s: Source) -> DataFrame:
    return s.events.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("", "SELECT doc_id, '{' || chr(10) || '  \"doc_id\" : ' || doc_id || ',' || chr(10) || '  \"lang\" : \"' || lang || '\",' || chr(10) || '  \"n_chars\" : ' || n_chars || chr(10) || '}' AS shown FROM documents WHERE doc_id = 11")
def view_result(s: Source) -> DataFrame:
    return s.documents.where("doc_id = 11").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars"), {"pretty": "true"}).alias("shown"))


@query(
    "",
    "SELECT id, version, vector FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1",
    "b AS (SELECT vec_id AS id, 1 AS version, embedding[1] AS vector FROM embeddings UNION ALL SELECT vec_id, 2, embedding[2] FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 100000, 2, embedding[3] FROM embeddings WHERE vec_id % 5 = 0)",
)
def vector_upsert(s: Source) -> DataFrame:
    row = lambda id_, v, i: s.embeddings.select((F.col("vec_id") + id_).alias("id"), F.lit(v).alias("version"), F.get("embedding", F.lit(i)).alias("vector"))
    return store.vector_upsert(row(0, 1, 0), row(0, 2, 1).where("id % 3 = 0"), row(100000, 2, 2).where("(id - 100000) % 5 = 0"))


@query("", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0")
def insert_append(s: Source) -> DataFrame:
    own = s.documents.select("doc_id", "source")
    return store.insert_append(own.where("doc_id % 2 = 0"), own.where("doc_id % 3 = 0"))


@query("", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def insert_new_only(s: Source) -> DataFrame:
    own = s.documents.select("doc_id", "source")
    return store.insert_append(own.where("doc_id % 2 = 0"), own.where("doc_id % 3 = 0"), key="doc_id")


@query("ocr_results", "SELECT id, filename, coalesce(pages, 0) AS pages, coalesce(columns, 0) AS columns, coalesce(characters, 0) AS characters, coalesce(processing_time, 0) AS processing_time, user_id FROM ocr_results")
def save_result_defaults(s: Source) -> DataFrame:
    return store.result_defaults(s.ocr_results).drop("text", "created_at")


@query("", "SELECT page_id, cast(30 + cast(trunc(page_id / (SELECT count(*) FROM pages) * 50) AS INTEGER) AS INTEGER) AS percent FROM pages")
def progress_percent(s: Source) -> DataFrame:
    total = s.pages.agg(F.count(F.lit(1)).alias("total"))
    return s.pages.join(F.broadcast(total)).select("page_id", streams.progress_percent(F.col("page_id"), F.col("total")).alias("percent"))


@query("ocr_results", "SELECT id, coalesce(pages, 0) AS pages, 1 AS columns, length(text) AS characters, round(coalesce(processing_time, 0), 1) AS time FROM ocr_results")
def result_stats(s: Source) -> DataFrame:
    return s.ocr_results.select("id", F.coalesce("pages", F.lit(0)).alias("pages"), F.lit(1).alias("columns"), F.length("text").alias("characters"), F.round(F.coalesce("processing_time", F.lit(0.0)), 1).alias("time"))


STATS = "SELECT user_id, cast(sum(coalesce(pages, 0)) AS BIGINT) AS total_pages, count(*) AS total_documents, max(created_at) AS last_activity FROM {} WHERE user_id IS NOT NULL {} GROUP BY user_id"


@query("ocr_results", STATS.format("ocr_results", ""))
def user_stats(s: Source) -> DataFrame:
    return store.user_stats(s.ocr_results)


@query("ocr_results", STATS.format("ocr_results", ""))
def user_stats_merge(s: Source) -> DataFrame:
    own = s.ocr_results
    return store.user_stats_merge(store.user_stats(own.where("id < 400")), store.user_stats(own.where("id >= 400")))


@query("ocr_results", STATS.format("ocr_results", "AND user_id = 7"))
def get_usage_stats(s: Source) -> DataFrame:
    return store.user_stats(store.owned_by(s.ocr_results, ME))


@query("ocr_results", "SELECT count(*) AS total, count(*) FILTER (cast(created_at AS DATE) = (SELECT cast(max(created_at) AS DATE) FROM ocr_results)) AS today, 0 AS processing FROM (SELECT * FROM ocr_results ORDER BY created_at DESC, id DESC LIMIT 1000)")
def dashboard_counts(s: Source) -> DataFrame:
    latest = s.ocr_results.orderBy(F.desc("created_at"), F.desc("id")).limit(1000)
    day = s.ocr_results.agg(F.max(F.to_date("created_at")).alias("day"))
    own = latest.join(F.broadcast(day))
    return own.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.to_date("created_at") == F.col("day")).alias("today")).withColumn("processing", F.lit(0))


@query("ocr_results", "SELECT id, filename, created_at FROM ocr_results WHERE user_id = 7 AND id = (SELECT min(id) FROM ocr_results WHERE user_id = 7)")
def get_result(s: Source) -> DataFrame:
    own = s.ocr_results
    first = own.where(F.col("user_id") == ME).agg(F.min("id").alias("id"))
    return store.owned_by(own, ME).join(first, "id", "left_semi").select("id", "filename", "created_at")


@query("ocr_results", "SELECT id, user_id FROM ocr_results r WHERE NOT (id % 6 = 0 AND user_id IS NOT NULL AND user_id = id % 25)")
def delete_owned(s: Source) -> DataFrame:
    asked = s.ocr_results.where("id % 6 = 0").select("id", (F.col("id") % 25).alias("user_id"))
    return store.delete_owned(s.ocr_results, asked).select("id", "user_id")


@query("ocr_results", "SELECT id, user_id FROM ocr_results WHERE user_id = 7 OR user_id IS NULL")
def rls_select(s: Source) -> DataFrame:
    return store.visible_to(s.ocr_results, ME).select("id", "user_id")


@query("ocr_results", "SELECT id, CASE WHEN id = 7 AND user_id = 7 OR id = 32 AND user_id = 7 THEN 'new name.pdf' ELSE filename END AS filename FROM ocr_results")
def rename_owned(s: Source) -> DataFrame:
    once = store.rename_owned(s.ocr_results, ME, F.lit(7), "  new name.pdf ")
    return store.rename_owned(once, ME, F.lit(32), " new name.pdf").select("id", "filename")


@query("ocr_results", "SELECT id, created_at FROM ocr_results WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10")
def history_page(s: Source) -> DataFrame:
    return store.history_page(s.ocr_results, ME, page=1).select("id", "created_at")


@query("ocr_results", "SELECT id, created_at FROM ocr_results WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 5")
def history_topn(s: Source) -> DataFrame:
    return store.history_page(s.ocr_results, ME, size=5).select("id", "created_at")


@query("ocr_results", "SELECT count(*) > 10 AS has_more FROM (SELECT id FROM ocr_results WHERE user_id = 7 LIMIT 11)")
def history_has_more(s: Source) -> DataFrame:
    return store.owned_by(s.ocr_results, ME).limit(11).agg((F.count(F.lit(1)) > 10).alias("has_more"))


@query(
    "",
    "SELECT user_id, unnest(r.ids) AS event_id, unnest(r.oks) AS accepted FROM f",
    """o AS (SELECT user_id, list({'held': [epoch_us(ts)], 'ids': [event_id], 'oks': [true]} ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
    f AS (SELECT user_id, list_reduce(v, lambda a, b: {'held': CASE WHEN len(list_filter(a.held, lambda t: b.held[1] - t <= 86400000000)) < 3
        THEN list_concat(list_filter(a.held, lambda t: b.held[1] - t <= 86400000000), b.held) ELSE list_filter(a.held, lambda t: b.held[1] - t <= 86400000000) END,
      'ids': list_concat(a.ids, b.ids), 'oks': list_append(a.oks, len(list_filter(a.held, lambda t: b.held[1] - t <= 86400000000)) < 3)}) AS r FROM o)""",
)
def rate_limit(s: Source) -> DataFrame:
    return store.rate_limit(s.events, "user_id", "ts", limit=3, seconds=86400)


@query(
    "",
    """SELECT query_id, rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
      (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 5""",
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)",
)
def cosine_topk(s: Source) -> DataFrame:
    return store.cosine_topk(s.embeddings, s.embeddings.where("vec_id % 20 = 0"))


@query(
    "",
    "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squares, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v)",
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)",
)
def l2_normalize(s: Source) -> DataFrame:
    unit = s.embeddings.select("vec_id", store.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s: Source) -> DataFrame:
    return streams.windowed(s.events)


@query(
    "",
    "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, g",
    """m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)""",
)
def event_sessions(s: Source) -> DataFrame:
    return streams.sessions(s.events)


@query(
    "",
    "SELECT lang, source, count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents GROUP BY ROLLUP (lang, source)",
)
def usage_rollup(s: Source) -> DataFrame:
    return s.documents.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("", "SELECT url AS path, 0 AS image_index, 'html' AS extension, sha256('data:image/html;base64,' || to_base64(encode(html))) AS address_sha256 FROM pages")
def image_manifest(s: Source) -> DataFrame:
    """Images of a folder of files as (path, index, extension, data address); here each page stands for a file."""
    files = s.pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    address = F.concat(F.lit("data:image/html;base64,"), F.translate(F.base64("content"), "\r\n", ""))
    return files.select("path", F.lit(0).alias("image_index"), F.lit("html").alias("extension"), F.sha2(address, 256).alias("address_sha256"))


@query("", "SELECT page_id, octet_length(encode('%PDF-1.7 ' || html))::INTEGER AS length FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, octet_length(encode(html))::INTEGER FROM pages WHERE page_id % 3 > 0 AND substr(html, 1, 4) = '%PDF'")
def pdf_magic_filter(s: Source) -> DataFrame:
    """Files with the magic bytes; a third of the pages are given them."""
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).otherwise(F.col("html"))
    return tables.only_pdf(s.pages.select("page_id", body.cast("binary").alias("content"))).select("page_id", F.length("content").alias("length"))


@query("ocr_results", "SELECT id, user_id FROM ocr_results WHERE user_id IS NULL OR user_id % 3 <> 0")
def fk_rows(s: Source) -> DataFrame:
    own = s.ocr_results.select("id", "user_id")
    return store.with_parent(own, own.select("user_id").where("user_id % 3 <> 0").distinct(), "user_id")


@query("ocr_results", "SELECT id, user_id FROM ocr_results WHERE user_id IS NULL OR user_id % 5 <> 0")
def cascade_delete(s: Source) -> DataFrame:
    own = s.ocr_results.select("id", "user_id")
    return store.cascade_delete(own, own.select("user_id").where("user_id % 5 = 0").distinct(), "user_id")


@query("ocr_results", "SELECT id, CASE WHEN id % 7 = 0 THEN 'f' || id ELSE filename END AS filename, id % 7 = 0 OR updated_at > created_at AS stamped FROM (SELECT *, created_at AS updated_at FROM ocr_results)")
def update_stamp(s: Source) -> DataFrame:
    own = s.ocr_results.select("id", "filename", "created_at", F.col("created_at").alias("updated_at"))
    changes = own.where("id % 7 = 0").select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"))
    now = F.lit("2100-01-01 00:00:00").cast(own.schema["updated_at"].dataType)
    return store.update_rows(own, changes, "id", now).select("id", "filename", (F.col("updated_at") > F.col("created_at")).alias("stamped"))


@query("", "SELECT page_id, 'bad body' AS msg, '<' || octet_length(encode(html)) || ' bytes>' AS body, '<' || octet_length(encode(url)) || ' bytes>' AS part FROM pages")
def sanitize_errors(s: Source) -> DataFrame:
    ctx = F.struct(F.col("html").cast("binary").alias("body"), F.array(F.col("url").cast("binary")).alias("parts"))
    errors = store.safe_errors(s.pages.select("page_id", F.lit("bad body").alias("msg"), ctx.alias("ctx")))
    return errors.select("page_id", "msg", F.col("ctx.body").alias("body"), F.get("ctx.parts", F.lit(0)).alias("part"))


@query("", "SELECT user_id AS task, (event_id * 7 % 101)::INTEGER AS percent, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_progress(s: Source) -> DataFrame:
    announced = s.events.select(F.col("user_id").alias("task"), "event_id", "ts", (F.col("event_id") * 7 % 101).cast("int").alias("percent"))
    return streams.latest_progress(announced)
