"""Queries over regions, attempts and quality, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import quality
from foliant.operators import layout, select
from foliant.plans.queries import Source, query

# --- SQL pieces ----------------------------------------------------------------------------------------------

GAPS = """scan AS (SELECT r.*, s.s AS scan_y FROM regions r, (SELECT unnest(range(0, 3200, 320)) AS s) s WHERE s.s BETWEEN y AND y + h),
  g AS (SELECT page_id, page_w, scan_y, x + w AS e, lead(x) OVER (PARTITION BY page_id, scan_y ORDER BY x, region_id) AS nx FROM scan),
  gaps AS (SELECT page_id, page_w, scan_y, (e + nx) // 2 AS gap_x FROM g WHERE nx - e >= 30)"""
COLUMNS = f"""{GAPS}, m AS (SELECT *, CASE WHEN gap_x - lag(gap_x) OVER (PARTITION BY page_id ORDER BY gap_x, scan_y) >= 100 THEN 1 ELSE 0 END AS new FROM gaps),
  c AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY gap_x, scan_y) AS k FROM m),
  cuts AS (SELECT page_id, cast(trunc(median(gap_x)) AS BIGINT) AS cut FROM c GROUP BY page_id, k HAVING count(*) >= 3),
  edges AS (SELECT page_id, list_concat([0], list_concat(coalesce(cs, []), [2400])) AS e FROM (SELECT DISTINCT page_id FROM regions) LEFT JOIN (SELECT page_id, list(cut ORDER BY cut) AS cs FROM cuts GROUP BY page_id) USING (page_id)),
  cols AS (SELECT page_id, i - 1 AS column_index, e[i] AS x_start, e[i + 1] AS x_end FROM (SELECT page_id, e, unnest(range(1, len(e))) AS i FROM edges))"""
ASSIGNED = f"""{COLUMNS}, assigned AS (SELECT r.*, coalesce((SELECT min(column_index) FROM cols WHERE cols.page_id = r.page_id AND r.x + r.w // 2 BETWEEN x_start AND x_end), 0) AS column_index FROM regions r)"""
ORDERED = f"""{ASSIGNED}, named AS (SELECT *, CASE WHEN y < 100 THEN 0 WHEN y + h > 3100 THEN 2 ELSE 1 END AS grp FROM assigned),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY grp, CASE WHEN grp = 1 THEN column_index ELSE 0 END, y, region_id) - 1 AS reading_order FROM named)"""
TYPED = """sized AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM boxes WHERE x2 - x1 >= 50 AND y2 - y1 >= 20),
  typed AS (SELECT *, CASE WHEN y1 < 100 THEN 'header' WHEN y2 > 1500 THEN 'footer' WHEN y1 < 320 AND w > 720 AND h > 40 THEN 'title' WHEN w > 600 AND h > 25 AND h < 60 THEN 'heading'
    WHEN w / h > 0.5 AND w / h < 2 AND w > 200 AND h > 100 THEN 'table' ELSE 'text' END AS region_type FROM sized)"""
STARTS = f"""{TYPED}, xs AS (SELECT page_id, list((x1 + x2) // 2 ORDER BY (x1 + x2) // 2) AS v FROM typed WHERE region_type = 'text' GROUP BY page_id),
  starts AS (SELECT page_id, list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 30 THEN list_concat(a, b) ELSE a END) AS starts FROM xs)"""
NEAR = f"""{STARTS}, near AS (SELECT t.*, CASE WHEN region_type = 'text' THEN coalesce(list_position(list_transform(s.starts, lambda c: abs((x1 + x2) // 2 - c)), list_min(list_transform(s.starts, lambda c: abs((x1 + x2) // 2 - c)))) - 1, 0) ELSE 0 END AS column_id
  FROM typed t LEFT JOIN starts s USING (page_id))"""
RANK = "list_position(['header', 'title', 'heading', 'text', 'table', 'footer'], region_type)"
MERGED = """ys AS (SELECT page_id, list_sort(list_distinct(list((y1 + y2) // 2))) AS v FROM separator_lines GROUP BY page_id),
  merged AS (SELECT page_id, list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] <= 20 THEN list_concat(a[:-2], [(a[-1] + b[1]) // 2]) ELSE list_concat(a, b) END) AS separator_ys FROM ys)"""


@query("regions", "SELECT page_id, scan_y, region_id FROM scan", GAPS)
def range_join_scanlines(s: Source) -> DataFrame:
    return layout.scanlines(s.regions).select("page_id", "scan_y", "region_id")


@query("regions", "SELECT page_id, scan_y, gap_x FROM gaps", GAPS)
def column_gaps(s: Source) -> DataFrame:
    return layout.column_gaps(s.regions).select("page_id", "scan_y", "gap_x")


@query("regions", "SELECT page_id, column_index, x_start, x_end FROM cols", COLUMNS)
def detect_columns(s: Source) -> DataFrame:
    return layout.detect_columns(s.regions)


def assigned(s: Source) -> DataFrame:
    regions = s.regions
    return layout.assign_columns(regions, layout.detect_columns(regions))


@query("regions", "SELECT region_id, column_index FROM assigned", ASSIGNED)
def assign_columns(s: Source) -> DataFrame:
    return assigned(s).select("region_id", "column_index")


@query("regions", "SELECT region_id, ['header', 'body', 'footer'][grp + 1] AS region_kind, reading_order FROM ordered", ORDERED)
def reading_order(s: Source) -> DataFrame:
    return layout.reading_order(assigned(s)).select("region_id", "region_kind", "reading_order")


@query(
    "regions",
    "SELECT page_id, coalesce(string_agg(piece, '' ORDER BY reading_order) FILTER (trim(text) <> ''), '') AS text FROM p GROUP BY page_id",
    ORDERED
    + ", p AS (SELECT page_id, reading_order, text, (CASE WHEN column_index > lag(column_index) OVER (PARTITION BY page_id ORDER BY reading_order) THEN chr(10) || chr(10) ELSE '' END) || trim(text) || chr(10) AS piece FROM ordered)",
)
def reading_text(s: Source) -> DataFrame:
    return layout.reading_text(layout.reading_order(assigned(s)))


@query("boxes", "SELECT region_id, region_type, CASE WHEN region_type = 'text' THEN 'body' ELSE region_type END AS position FROM typed", TYPED)
def classify_regions(s: Source) -> DataFrame:
    return layout.classify_regions(s.boxes).select("region_id", "region_type", "position")


@query("boxes", "SELECT page_id, array_to_string(starts, ',') AS starts FROM starts", STARTS)
def cluster_columns(s: Source) -> DataFrame:
    own = layout.cluster_columns(layout.classify_regions(s.boxes))
    return own.select("page_id", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query("boxes", "SELECT region_id, column_id FROM near", NEAR)
def nearest_column(s: Source) -> DataFrame:
    typed = layout.classify_regions(s.boxes)
    return layout.nearest_column(typed, layout.cluster_columns(typed)).select("region_id", "column_id")


_ORDER = f"row_number() OVER (PARTITION BY page_id ORDER BY {RANK}, CASE WHEN region_type = 'text' THEN column_id ELSE 0 END, y1, region_id) - 1"


@query("boxes", f"SELECT region_id, {_ORDER} AS layout_order FROM near", NEAR)
def layout_order(s: Source) -> DataFrame:
    return layout.analyze_layout(s.boxes).select("region_id", "layout_order")


@query("boxes", f"SELECT region_id, region_type, CASE WHEN region_type = 'text' THEN 'body' ELSE region_type END AS position, column_id, {_ORDER} AS layout_order FROM near", NEAR)
def analyze_layout(s: Source) -> DataFrame:
    return layout.analyze_layout(s.boxes).select("region_id", "region_type", "position", "column_id", "layout_order")


@query("regions", "SELECT region_id FROM regions WHERE w * h >= 2400 * 3200 * 0.00005 AND w >= 15 AND h >= 10")
def filter_regions(s: Source) -> DataFrame:
    return layout.filter_regions(s.regions).select("region_id")


@query("separator_lines", "SELECT line_id FROM separator_lines WHERE x2 <> x1 AND degrees(abs(atan((y2 - y1) / (x2 - x1)))) < 10")
def horizontal_lines(s: Source) -> DataFrame:
    return layout.horizontal_lines(s.separator_lines).select("line_id")


@query("separator_lines", "SELECT page_id, array_to_string(separator_ys, ',') AS separator_ys FROM merged", MERGED)
def merge_lines(s: Source) -> DataFrame:
    own = layout.merge_lines(s.separator_lines)
    return own.select("page_id", F.array_join(F.col("separator_ys").cast("array<string>"), ",").alias("separator_ys"))


@query(
    "separator_lines",
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS crop_no, y1, y2 FROM c WHERE y2 - y1 > 50",
    MERGED
    + ", e AS (SELECT page_id, list_concat([0], list_concat(separator_ys, [3200])) AS e FROM merged), c AS (SELECT page_id, i, greatest(0, e[i] - 10) AS y1, least(3200, e[i + 1] + 10) AS y2 FROM (SELECT page_id, e, unnest(range(1, len(e))) AS i FROM e))",
)
def crop_intervals(s: Source) -> DataFrame:
    return layout.crop_intervals(layout.merge_lines(s.separator_lines), 3200)


_SIZES = "p AS (SELECT page_id, 600 + page_id % 7 * 13 AS w, 800 + page_id % 5 * 17 AS h FROM pages), b AS (SELECT *, cast(floor(0.2 * h) AS BIGINT) AS t, cast(floor(0.5 * w) AS BIGINT) AS m FROM p)"


@query(
    "",
    """SELECT page_id, 'header' AS band, 0 AS x1, 0 AS y1, w - 1 AS x2, greatest(0, t - 1) AS y2 FROM b UNION ALL SELECT page_id, 'ref', 0, 0, greatest(0, m - 1), greatest(0, t - 1) FROM b
    UNION ALL SELECT page_id, 'date', m, 0, w - 1, greatest(0, t - 1) FROM b UNION ALL SELECT page_id, 'body', 0, t, w - 1, h - 1 FROM b""",
    _SIZES,
)
def page_bands(s: Source) -> DataFrame:
    sizes = s.pages.select("page_id", (600 + F.col("page_id") % 7 * 13).alias("page_w"), (800 + F.col("page_id") % 5 * 17).alias("page_h"))
    return layout.page_bands(sizes).drop("page_w", "page_h")


@query("boxes", "SELECT region_id, page_id, name FROM (SELECT *, max(CASE WHEN name = 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS has FROM boxes) WHERE has = 0 OR name = 'body'")
def body_regions(s: Source) -> DataFrame:
    return layout.body_regions(s.boxes).select("region_id", "page_id", "name")


@query(
    "boxes",
    "SELECT * FROM c WHERE x2 > x1 AND y2 > y1 AND x2 - x1 >= 7 AND y2 - y1 >= 7",
    "c AS (SELECT region_id, page_id, greatest(0, least(x1, 1199)) AS x1, greatest(0, least(y1, 1599)) AS y1, greatest(0, least(x2, 1199)) AS x2, greatest(0, least(y2, 1599)) AS y2 FROM boxes)",
)
def clamp_regions(s: Source) -> DataFrame:
    return layout.clamp_regions(s.boxes)


@query("regions", "SELECT region_id, printf('segment_%04d_page%02d_region%02d.png', row_number() OVER (ORDER BY page_id, region_id) - 1, page_id, row_number() OVER (PARTITION BY page_id ORDER BY region_id) - 1) AS file_name FROM regions")
def segment_naming(s: Source) -> DataFrame:
    return layout.segment_naming(s.regions)


# --- attempts ------------------------------------------------------------------------------------------------

_BEST = "sc AS (SELECT page_id, attempt_no, confidence FROM attempts WHERE kind = 'scale' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, attempt_no) = 1), ini AS (SELECT page_id, confidence FROM attempts WHERE kind = 'initial')"
_RETRY = f"""{_BEST}, tr AS (SELECT page_id, list({{'c': confidence, 'a': attempt_no, 'n': 0, 't': [70, 60, 50, 40, 30][attempt_no - 2]}} ORDER BY attempt_no) AS v FROM attempts WHERE kind = 'retry' GROUP BY page_id),
  rt AS (SELECT page_id, list_reduce(list_concat([{{'c': ini.confidence, 'a': 0, 'n': 0, 't': 0}}], v), lambda acc, x:
    CASE WHEN acc.c < 70 AND acc.c < x.t AND acc.n < 3 THEN
      CASE WHEN x.c > acc.c THEN {{'c': x.c, 'a': x.a, 'n': acc.n + 1, 't': 0}} ELSE {{'c': acc.c, 'a': acc.a, 'n': acc.n + 1, 't': 0}} END ELSE acc END) AS r FROM ini JOIN tr USING (page_id))"""


@query("attempts", "SELECT page_id, attempt_no, confidence FROM sc", _BEST)
def multiscale_select(s: Source) -> DataFrame:
    return select.multiscale_select(s.attempts)


@query("attempts", "SELECT page_id, attempt_no, confidence FROM attempts WHERE kind = 'scale' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY text_length DESC, attempt_no) = 1")
def multiscale_longest(s: Source) -> DataFrame:
    return select.multiscale_select(s.attempts, "longest")


@query("attempts", "SELECT ini.page_id, CASE WHEN ini.confidence >= 70 THEN 0 ELSE sc.attempt_no END AS attempt_no, CASE WHEN ini.confidence >= 70 THEN ini.confidence ELSE sc.confidence END AS confidence FROM ini JOIN sc USING (page_id)", _BEST)
def adaptive_scale(s: Source) -> DataFrame:
    return select.adaptive_scale(s.attempts)


@query("attempts", "SELECT page_id, r.a AS attempt_no, r.c AS confidence, r.n AS n_retries FROM rt", _RETRY)
def retry_select(s: Source) -> DataFrame:
    return select.retry_select(s.attempts)


@query(
    "attempts",
    """SELECT page_id, CASE WHEN mc < 70 AND rt.r.c > mc THEN rt.r.a ELSE ma END AS attempt_no, CASE WHEN mc < 70 AND rt.r.c > mc THEN rt.r.c ELSE mc END AS confidence FROM
    (SELECT page_id, CASE WHEN ini.confidence < 70 AND sc.confidence > ini.confidence THEN sc.confidence ELSE ini.confidence END AS mc, CASE WHEN ini.confidence < 70 AND sc.confidence > ini.confidence THEN sc.attempt_no ELSE 0 END AS ma
     FROM ini JOIN sc USING (page_id)) JOIN rt USING (page_id)""",
    _RETRY,
)
def smart_select(s: Source) -> DataFrame:
    return select.smart_select(s.attempts)


@query("attempts", "SELECT page_id, strategy FROM attempts, (VALUES ('aggressive_denoise', 70), ('adaptive_threshold', 60), ('morphological_enhance', 50), ('super_contrast', 40), ('sharpen', 30)) v(strategy, t) WHERE kind = 'initial' AND confidence < 70 AND confidence < t")
def retry_plan(s: Source) -> DataFrame:
    return select.retry_plan(s.attempts)


@query("attempts", "SELECT page_id, CASE WHEN l >= c - 0.05 THEN 'latin' ELSE 'cyrillic' END AS script FROM (SELECT page_id, max(confidence) FILTER (attempt_no = 1) AS l, max(confidence) FILTER (attempt_no = 2) AS c FROM attempts GROUP BY page_id)")
def ensemble_select(s: Source) -> DataFrame:
    both = s.attempts.groupBy("page_id").agg(*[F.max(F.when(F.col("attempt_no") == n, F.col("confidence"))).alias(x) for n, x in ((1, "l"), (2, "c"))])
    return both.select("page_id", select.ensemble_select(F.col("l"), F.col("c")).alias("script"))


_TYPES = "CASE page_id % 3 WHEN 0 THEN 'newspaper' WHEN 1 THEN 'letter' ELSE 'form' END"


@query(
    "attempts",
    "SELECT t.doc_type, coalesce(k.scales, '1.0,1.5,2.0') AS scales FROM (VALUES ('newspaper'), ('letter'), ('form'), ('poster')) t(doc_type) LEFT JOIN k USING (doc_type)",
    f"""m AS (SELECT {_TYPES} AS doc_type, 1.0e0 + attempt_no * 0.5e0 AS scale, avg(confidence) AS c, min(page_id * 8 + attempt_no) AS f FROM attempts GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY c DESC, f) AS n FROM m), k AS (SELECT doc_type, string_agg(cast(scale AS VARCHAR), ',' ORDER BY n) AS scales FROM r WHERE n <= 3 GROUP BY doc_type)""",
)
def scale_topk(s: Source) -> DataFrame:
    history = s.attempts.select(F.expr(_TYPES).alias("doc_type"), (1.0 + F.col("attempt_no") * 0.5).alias("scale"), "confidence", (F.col("page_id") * 8 + F.col("attempt_no")).alias("seq"))
    types = s.spark.createDataFrame([(t,) for t in ("newspaper", "letter", "form", "poster")], "doc_type string")
    return select.scale_topk(history, types).select("doc_type", F.array_join(F.col("scales").cast("array<string>"), ",").alias("scales"))


@query("", "SELECT event_id % 4 AS method, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1")
def bench_summary(s: Source) -> DataFrame:
    named = s.events.withColumn("label", F.concat((F.col("event_id") % 4).cast("string"), F.lit(" (run "), F.col("event_id").cast("string"), F.lit(")")))
    own = named.groupBy(F.trim(F.split("label", r"\(")[0]).cast("long").alias("method"))
    return own.agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


# --- quality -------------------------------------------------------------------------------------------------

_SCORE = """greatest(0, least(1, 0.30e0 * least(lap_var / 1000, 1) + 0.25e0 * least(std / 70, 1) + 0.15e0 * least(edge_density * 10, 1) + 0.20e0 * (1 - least(noise / 20, 1)) + 0.10e0 * (max_val - min_val) / 255))"""


def _score():
    return quality.quality_score(*[F.col(c) for c in ("lap_var", "std", "edge_density", "noise", "min_val", "max_val")])


@query("page_metrics", f"SELECT doc_id, round({_SCORE}, 6) AS score FROM page_metrics")
def quality_score(s: Source) -> DataFrame:
    return s.page_metrics.select("doc_id", F.round(_score(), 6).alias("score"))


@query("page_metrics", f"SELECT doc_id, CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'good' WHEN s >= 0.4 THEN 'medium' ELSE 'poor' END AS tier FROM (SELECT doc_id, round({_SCORE}, 9) AS s FROM page_metrics)")
def quality_tier(s: Source) -> DataFrame:
    return s.page_metrics.select("doc_id", quality.quality_tier(F.round(_score(), 9)).alias("tier"))


@query(
    "font_spans",
    "SELECT doc_id, CASE WHEN v IS NULL THEN 600 WHEN i THEN greatest(400, d) ELSE d END AS dpi FROM (SELECT d.doc_id, v, i, CASE WHEN v[len(v) // 2 + 1] >= 12 THEN 300 WHEN v[len(v) // 2 + 1] >= 9 THEN 400 ELSE 600 END AS d FROM documents d LEFT JOIN f USING (doc_id))",
    "f AS (SELECT doc_id, list(size ORDER BY size) AS v, bool_or(has_image) AS i FROM font_spans GROUP BY doc_id)",
)
def optimal_dpi(s: Source) -> DataFrame:
    fonts = s.font_spans.groupBy("doc_id").agg(F.collect_list("size").alias("sizes"), F.bool_or("has_image").alias("has_image"))
    both = s.documents.select("doc_id").join(fonts, "doc_id", "left")
    sizes = F.coalesce("sizes", F.array().cast("array<bigint>"))
    return both.select("doc_id", quality.optimal_dpi(sizes, F.coalesce("has_image", F.lit(False))).alias("dpi"))


@query(
    "uploads",
    """SELECT id, CASE WHEN coalesce(content_type, '') <> 'application/pdf' THEN 'Only PDF uploads are supported at the moment.' WHEN size_bytes = 0 THEN 'Uploaded file is empty.'
    WHEN size_bytes / 1048576 > 25 THEN 'File is too large. Maximum size is 25MB.' END AS error FROM uploads""",
)
def validate_upload(s: Source) -> DataFrame:
    return s.uploads.select("id", quality.upload_error(F.col("content_type"), F.col("size_bytes")).alias("error"))
