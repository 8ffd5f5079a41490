"""Registered queries, each with its oracle in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import quality, structure, text
from foliant.operators import layout, lines, select, store
from foliant.plans import pipeline
from foliant.sources import tables
from foliant.sources.fixtures import duck, spark_view
from foliant.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Tables and derived views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return spark_view(self.spark, self.sf_dir, name)
        except KeyError:
            return tables.table(self.spark, self.sf_dir, name)


def query(views: str = "", oracle: str | None = None, ctes: str = ""):
    """Registers a function of a Source; the oracle's SQL may use the named views and further tables (ctes)."""

    def add(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle:
            heads = [*map(duck, views.split()), *([ctes] if ctes else [])]
            ORACLES[fn.__name__] = ("WITH " + ", ".join(heads) + " " if heads else "") + oracle
        return fn

    return add


# --- SQL pieces of the oracles -------------------------------------------------------------------------------


def rep(x: str, *rules: tuple[str, str]) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def s_strip(x: str) -> str:
    return rep(x, (r"^\s+|\s+$", ""))


def s_lines(x: str, body: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda ln: {body}), chr(10))"


def s_clean(x: str) -> str:
    x = s_lines(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')", s_strip("ln"))
    x = rep(x, (rf"({W})-\n({W})", r"\1\2"), (r"\s+([.,;:!?)])", r"\1"), (r"([.,;:!?])([^\s\d])", r"\1 \2"), (" {2,}", " "))
    x = f"regexp_replace({x}, '\\n[a-zA-Zа-яА-ЯёЁ0-9]\\n', chr(10), 'g')"
    return s_strip(rep(x, (r'"\s+', '"'), (r'\s+"', '"')))


def s_normal(x: str) -> str:
    one = rep(s_strip(rep("ln", (r"\s+", " "))), (rf"(^|{NW})O(\d)", r"\10\2"), (rf"(\d)O({NW}|$)", r"\10\2"), (rf"(\d)\s*,\s*(\d{{3}})({NW}|$)", r"\1\2\3"))
    return s_lines(x, one)


def s_noise(x: str) -> str:
    s = s_strip("ln")
    return f"""array_to_string(list_filter(string_split({x}, chr(10)), lambda ln: NOT ({s} <> '' AND (
      (length({rep(s, (r"[^\p{L}\p{N}]", ""))}) / greatest(length({s}), 1) < 0.4 AND length({s}) > 10)
      OR len(regexp_extract_all({s}, '[A-Z]{{6,}}')) > 2
      OR len(list_filter(list_distinct(list_filter(string_split_regex({s}, '\\s+'), lambda t: length(t) <= 4)),
           lambda t: len(list_filter(string_split_regex({s}, '\\s+'), lambda u: u = t)) > 3)) > 2))), chr(10))"""


def s_char(x: str) -> str:
    x = rep(f"translate({x}, 'ОоІі', 'OoIi')", ("0([^0-9]|$)", r"O\1"), ("([^0-9])1([^0-9])", r"\1l\2"), ("([^0-9])1([^0-9])", r"\1l\2"))
    return s_strip(rep(x, (r"\s+", " ")))


def s_postocr(x: str) -> str:
    for word, new in (("0", "O"), ("l", "I"), ("rn", "m"), ("vv", "w")):
        x = rep(x, *[(f"(^|{NW}){word}({NW}|$)", rf"\1{new}\2")] * 2)
    x = f"replace(replace(translate({x}, 'аеорсух', 'aeopcyx'), 'o''', 'oʻ'), 'g''', 'gʻ')"
    x = rep(x, (r"\s+", " "), (rf"({W}+)-\s+({W}+)", r"\1\2"), (r"\s+([.,;:!?])", r"\1"), ("([.,;:!?])([А-Яа-яA-Za-z])", r"\1 \2"), (r"\s+", " "))
    fix = """CASE WHEN contains(w, '0') THEN replace(w, '0', 'O') WHEN contains(w, 'l') THEN replace(w, 'l', 'I')
      WHEN contains(w, 'ch') OR contains(w, 'sh') THEN w WHEN contains(w, 'g''') THEN replace(w, 'g''', 'gʻ')
      WHEN contains(w, 'o''') THEN replace(w, 'o''', 'oʻ') ELSE w END"""
    return f"array_to_string(list_transform(string_split({s_strip(x)}, ' '), lambda w: {fix}), ' ')"


def s_script(x: str) -> str:
    lat, cyr = f"length({rep(f'lower({x})', ('[^a-zʻ]', ''))})", f"length({rep(f'lower({x})', ('[^абвгдеёжзийклмнопрстуфхцчшщъыьэюяўқғҳ]', ''))})"
    return f"CASE WHEN {lat} + {cyr} = 0 THEN 'unknown' WHEN {lat} / ({lat} + {cyr}) > 0.7 THEN 'latin' WHEN {lat} / ({lat} + {cyr}) < 0.3 THEN 'cyrillic' ELSE 'mixed' END"


def s_ref(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?i)(?:№|No\.?|N\.?|#)\s*([0-9]+/[0-9]{{4}})', 1), '')"


def s_date(x: str) -> str:
    part = lambda i: rf"regexp_extract({x}, '(\d{{1,2}})[.\-/](\d{{1,2}})[.\-/](\d{{4}})', {i})"
    return f"CASE WHEN {part(3)} <> '' THEN {part(3)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(1)}, 2, '0') END"


def s_lang(x: str) -> str:
    return rf"CASE WHEN coalesce({x}, '') = '' THEN 'en' WHEN regexp_matches({x}, '[\x{{0400}}-\x{{04FF}}]') THEN 'uz-cyrillic' ELSE 'uz-latin' END"


def s_boundary(x: str) -> str:
    s = s_strip(x)
    let, up = f"length({rep(s, (r'[^\p{L}]', ''))})", f"length({rep(s, (r'[^\p{Lu}]', ''))})"
    return rf"""(regexp_matches(substr({s}, 1, 30), '(^|{NW})\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}($|{NW})') OR regexp_matches({s}, '(?:№|No\.?|N\.?)\s*\d+')
      OR (length({s}) > 25 AND {let} > 0 AND {up} / greatest({let}, 1) > 0.85) OR {s} IN ('OOO', '===') OR regexp_matches({s}, '^[A-Z0-9\-\s]{{20,}}$'))"""


def s_dedup(source: str, name: str = "deduped") -> str:
    """CTEs that end in `name` (doc_id, text)."""
    return f"""{name}_l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM {source}),
    {name}_n AS (SELECT *, CASE WHEN length({s_strip("line")}) >= 10 THEN lower({s_strip(rep("line", (r"\s+", " ")))}) END AS norm FROM {name}_l),
    {name}_c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS nth FROM {name}_n),
    {name} AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM {name}_c WHERE norm IS NULL OR n <= 3 OR nth = 1 GROUP BY doc_id)"""


def s_tables(source: str, name: str = "tabled") -> str:
    return rf"""{name}_l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM {source}),
    {name}_c AS (SELECT *, list_filter(string_split_regex({s_strip("line")}, '\s{{2,}}'), lambda s: s <> '') AS cells FROM {name}_l),
    {name}_r AS (SELECT *, CASE WHEN len(cells) >= 3 THEN array_to_string(cells, ' | ') END AS r FROM {name}_c),
    {name}_o AS (SELECT doc_id, pos, CASE WHEN r IS NULL THEN line ELSE (CASE WHEN pos > 1 AND lag(r) OVER w IS NULL THEN chr(10) ELSE '' END) || r
      || (CASE WHEN lead(pos) OVER w IS NOT NULL AND lead(r) OVER w IS NULL THEN chr(10) ELSE '' END) END AS piece FROM {name}_r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    {name} AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY pos) AS text FROM {name}_o GROUP BY doc_id)"""


def s_segments(source: str, name: str = "parts") -> str:
    return rf"""{name}_l AS (SELECT doc_id, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS pos, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM {source} WHERE text <> ''),
    {name}_b AS (SELECT *, sum(CASE WHEN pos > 1 AND {s_boundary("line")} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM {name}_l),
    {name}_g AS (SELECT doc_id, part, {s_strip("string_agg(line, chr(10) ORDER BY pos)")} AS segment FROM {name}_b GROUP BY doc_id, part),
    {name}_n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {name}_g),
    {name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS segment_no, segment FROM {name}_n
      WHERE n = 1 OR length({rep("segment", (r"[^\p{L}]", ""))}) >= 40)"""


def text_query(name: str, fn, sql: str, out: str = "text", view: str = "noisy_documents") -> None:
    """doc_id and one function of the text."""

    def run(s: Source) -> DataFrame:
        return getattr(s, view).select("doc_id", fn(F.col("text")).alias(out))

    run.__name__ = name
    query(view if view == "noisy_documents" else "", f"SELECT doc_id, {sql} AS {out} FROM {view}")(run)


# --- text ----------------------------------------------------------------------------------------------------

text_query("clean_text", text.clean_text, s_clean("text"))
text_query("normalize_lines", text.normalize_lines, s_normal("text"))
text_query("filter_noise_lines", text.filter_noise_lines, s_noise("text"))
text_query("char_correct", text.char_correct, s_char("text"))
text_query("postocr_correct", text.postocr_correct, s_postocr("text"))
text_query("detect_script", text.detect_script, s_script("text"), "script")
text_query("detect_language", structure.detect_language, s_lang("text"), "language")
text_query("extract_ref", structure.extract_ref, s_ref("text"), "ref")
text_query("extract_date", structure.extract_date, s_date("text"), "date")
text_query("vlm_confidence", quality.vlm_confidence, "least(0.95e0, 0.7e0 + length(text) / 1000 * 0.2e0)", "confidence")
text_query(
    "ocr_lang_route",
    text.ocr_lang_route,
    "(SELECT CASE WHEN l + c = 0 THEN 'uzb+rus+eng' WHEN c / (l + c) > 0.7 THEN 'rus+uzb' WHEN c / (l + c) < 0.3 THEN 'uzb+eng' ELSE 'uzb+rus+eng' END FROM "
    r"(SELECT length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS l, length(regexp_replace(lower(text), '[^\x{0400}-\x{04FF}]', '', 'g')) AS c))",
    "packs",
)
text_query("scan_page_text", text.page_text, s_strip("replace(text, chr(160), ' ')"))


@query(
    "noisy_documents",
    f"""SELECT doc_id, CASE WHEN {s_script("text")} <> 'mixed' THEN text WHEN main = 'latin' THEN translate(text, 'аеорсухАЕОРСУХ', 'aeopcyxAEOPCYX')
      WHEN main = 'cyrillic' THEN translate(text, 'aeopcyxAEOPCYX', 'аеорсухАЕОРСУХ') ELSE text END AS text FROM noisy_documents JOIN top USING (doc_id)""",
    rf"""words AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM noisy_documents)),
    kinds AS (SELECT doc_id, p, {s_script("w")} AS k FROM words), counted AS (SELECT doc_id, k, count(*) AS n, min(p) AS first FROM kinds GROUP BY doc_id, k),
    top AS (SELECT doc_id, k AS main FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)""",
)
def mixed_script_fix(s: Source) -> DataFrame:
    return s.noisy_documents.select("doc_id", text.mixed_script_fix(F.col("text")).alias("text"))


@query("", "SELECT lang, CASE lang WHEN 'en' THEN 'eng+uzb+rus' ELSE 'uzb+eng+rus' END AS packs, count(*) AS n FROM documents GROUP BY lang")
def map_lang(s: Source) -> DataFrame:
    return s.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("packs", text.map_lang(F.col("lang")))


@query("uploads", r"""SELECT id, replace(trim(trim(file_path), '"'), chr(92) || chr(92), chr(92)) AS path FROM uploads""")
def normalize_path(s: Source) -> DataFrame:
    return s.uploads.select("id", text.normalize_path(F.col("file_path")).alias("path"))


@query("uploads", "SELECT id, file_path FROM uploads WHERE trim(trim(file_path), '\"') LIKE '%.pdf'")
def batch_scan(s: Source) -> DataFrame:
    return s.uploads.where(text.normalize_path(F.col("file_path")).endswith(".pdf")).select("id", "file_path")


@query()
def edit_distance(s: Source) -> DataFrame:
    """Distance of neighbours' whole texts, in characters. No SQL: DuckDB's levenshtein counts bytes."""
    a, b = s.benchmark.alias("a"), s.benchmark.alias("b")
    joined = a.join(b, F.col("a.item_id") + 1 == F.col("b.item_id"))
    return joined.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.levenshtein("a.text", "b.text").cast("long").alias("distance"))


@query()
def similar_words(s: Source) -> DataFrame:
    """All words of every whole text on both sides, letters beyond A-Z and other signs included.

    No SQL: DuckDB's levenshtein counts bytes.
    """
    every = lambda df: df.select(F.explode(F.split("text", r"[\s.,]+")).alias("word")).where("word != ''").distinct()
    return lines.similar_words(every(s.conversations), every(s.benchmark)).withColumn("distance", F.col("distance").cast("long"))


@query("", "SELECT event_id, CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN cast(h AS VARCHAR) || 'h ago' WHEN h < 48 THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM a",
       "a AS (SELECT event_id, ts, cast(floor(epoch_us(max(ts) OVER () - ts) / 3600000000) AS BIGINT) AS h FROM events)")
def relative_time(s: Source) -> DataFrame:
    latest = s.events.agg(F.max("ts").alias("now"))
    return s.events.join(F.broadcast(latest)).select("event_id", structure.relative_time(F.col("ts"), F.col("now")).alias("label"))


@query("", "SELECT event_id, json_extract_string(props, '$.ref') AS ref, json_extract_string(props, '$.k') AS k FROM events")
def json_roundtrip(s: Source) -> DataFrame:
    parsed = s.events.select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    back = parsed.select("event_id", F.to_json("m").alias("j"))
    return back.select("event_id", F.get_json_object("j", "$.ref").alias("ref"), F.get_json_object("j", "$.k").alias("k"))


# --- lines, pages and documents -----------------------------------------------------------------------------


@query("noisy_documents", "SELECT doc_id, text FROM deduped", s_dedup("noisy_documents"))
def dedup_lines(s: Source) -> DataFrame:
    return lines.dedup_lines(s.noisy_documents)


@query("noisy_documents", "SELECT doc_id, text FROM tabled", s_tables("noisy_documents"))
def tables_as_text(s: Source) -> DataFrame:
    return lines.tables_as_text(s.noisy_documents)


@query("noisy_documents", "SELECT doc_id, segment_no, segment FROM parts", s_segments("noisy_documents"))
def split_announcements(s: Source) -> DataFrame:
    return lines.split_announcements(s.noisy_documents)


@query("noisy_documents", f"SELECT doc_id, pos - 1 AS pos FROM l WHERE {s_boundary('line')}",
       "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM noisy_documents)")
def boundary_lines(s: Source) -> DataFrame:
    own = lines.explode_lines(s.noisy_documents).where(structure.boundary_line(F.col("line")))
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("noisy_documents ocr_tokens", f"SELECT doc_id, CASE WHEN m IS NULL OR m < 45 THEN {s_noise('text')} ELSE text END AS text FROM noisy_documents LEFT JOIN t USING (doc_id)",
       "t AS (SELECT doc_id, coalesce(avg(conf) FILTER (conf >= 0), 0) AS m FROM ocr_tokens WHERE doc_id % 3 > 0 GROUP BY doc_id)")
def filter_low_conf_docs(s: Source) -> DataFrame:
    return lines.filter_low_confidence(s.noisy_documents, s.ocr_tokens.where("doc_id % 3 > 0"), least=45.0)


@query("", "SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def join_pages(s: Source) -> DataFrame:
    return lines.join_pages(s.conversations, "conv_id", "turn")


@query("", r"SELECT conv_id, max(a) >= 200 AND sum(a) / greatest(sum(n) + 2 * (count(*) - 1), 1) >= 0.3 AS reliable FROM p GROUP BY conv_id",
       r"p AS (SELECT conv_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS a, length(text) AS n FROM conversations)")
def reliable_text_gate(s: Source) -> DataFrame:
    return lines.reliable_text(s.conversations, "conv_id")


_CHAIN = f"""{s_dedup("noisy_documents", "d1")}, d2 AS (SELECT doc_id, {s_normal("text")} AS text FROM d1), d3 AS (SELECT doc_id, {s_noise("text")} AS text FROM d2),
  d4 AS (SELECT doc_id, {s_clean("text")} AS text FROM d3), {s_tables("d4", "d5")}, chain AS (SELECT doc_id, text AS clean_text, {s_char("text")} AS corrected FROM d5)"""


@query("noisy_documents", f"SELECT doc_id, {s_ref('clean_text')} AS ref, {s_date('clean_text')} AS date, {s_lang('clean_text')} AS language, clean_text, corrected FROM chain", _CHAIN)
def flagship(s: Source) -> DataFrame:
    return pipeline.flagship(s.noisy_documents)


@query(
    "noisy_documents",
    f"""SELECT c.doc_id, {s_ref("corrected")} AS ref, {s_date("corrected")} AS date, {s_lang("corrected")} AS language, corrected AS announcement, 'v1' AS schema_version,
      coalesce(len(r.s), 0) AS n_raw, coalesce(len(k.s), 0) AS n_clean, coalesce(len(o.s), 0) AS n_corrected, coalesce(array_to_string(k.s, '|'), '') AS segments_clean
    FROM chain c LEFT JOIN sr r USING (doc_id) LEFT JOIN sk k USING (doc_id) LEFT JOIN so o USING (doc_id)""",
    f"""{_CHAIN}, k0 AS (SELECT doc_id, clean_text AS text FROM chain), o0 AS (SELECT doc_id, corrected AS text FROM chain),
    {s_segments("noisy_documents", "pr")}, {s_segments("k0", "pk")}, {s_segments("o0", "po")},
    sr AS (SELECT doc_id, list(segment ORDER BY segment_no) AS s FROM pr GROUP BY doc_id), sk AS (SELECT doc_id, list(segment ORDER BY segment_no) AS s FROM pk GROUP BY doc_id),
    so AS (SELECT doc_id, list(segment ORDER BY segment_no) AS s FROM po GROUP BY doc_id)""",
)
def record(s: Source) -> DataFrame:
    made = pipeline.run(s.noisy_documents)
    sizes = [F.size(f"metadata.segments_{k}").cast("long").alias(f"n_{k}") for k in ("raw", "clean", "corrected")]
    return made.select("doc_id", "ref", "date", "language", "announcement", "schema_version", *sizes, F.array_join("metadata.segments_clean", "|").alias("segments_clean"))


@query("noisy_documents", f"SELECT doc_id, true AS ok, {s_ref('corrected')} AS ref, {s_date('corrected')} AS date, {s_lang('corrected')} AS language, cast(doc_id AS VARCHAR) || '.json' AS json_saved FROM chain", _CHAIN)
def process_summary(s: Source) -> DataFrame:
    chain, c = pipeline.text_chain(s.noisy_documents), F.col("corrected")
    return chain.select("doc_id", F.lit(True).alias("ok"), structure.extract_ref(c).alias("ref"), structure.extract_date(c).alias("date"), structure.detect_language(c).alias("language"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("json_saved"))


@query(
    "noisy_documents",
    """SELECT d.doc_id, CASE WHEN g.s IS NOT NULL AND d.doc_id % 7 > 0 THEN array_to_string(list_filter(g.s, lambda x: x <> ''), chr(10) || '===' || chr(10)) || chr(10) || '===' || chr(10)
      WHEN d.doc_id % 14 = 0 THEN '(No text)' ELSE text END AS body FROM noisy_documents d LEFT JOIN g USING (doc_id)""",
    s_segments("noisy_documents") + ", g AS (SELECT doc_id, list(segment ORDER BY segment_no) AS s FROM parts GROUP BY doc_id)",
)
def format_text(s: Source) -> DataFrame:
    docs = s.noisy_documents.withColumn("s", structure.announcements(F.col("text")))
    own = F.when(F.col("doc_id") % 7 > 0, F.col("s")).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", structure.format_text(own, F.when(F.col("doc_id") % 14 == 0, "").otherwise(F.col("text"))).alias("body"))


@query("ocr_tokens", "SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) FILTER (trim(text) <> '') AS text FROM ocr_tokens GROUP BY doc_id")
def ocr_region_text(s: Source) -> DataFrame:
    good = s.ocr_tokens.where(text.strip(F.col("text")) != "")
    return good.groupBy("doc_id").agg(lines.join_lines(F.collect_list(F.struct("pos", F.col("text").alias("line")))).alias("text"))


@query("ocr_tokens", rf"SELECT doc_id, pos, {s_strip('text')} AS text, conf FROM ocr_tokens WHERE {s_strip('text')} <> ''")
def ocr_token_rows(s: Source) -> DataFrame:
    return s.ocr_tokens.where(text.strip(F.col("text")) != "").select("doc_id", "pos", text.strip(F.col("text")).alias("text"), "conf")


@query("ocr_tokens", "SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (conf > 30), '') AS text, round(coalesce(avg(conf) FILTER (conf > 30), 0), 6) AS confidence FROM ocr_tokens GROUP BY doc_id")
def region_text_conf30(s: Source) -> DataFrame:
    return layout.region_text(s.ocr_tokens, "doc_id").withColumn("confidence", F.round("confidence", 6))


@query("ocr_tokens", "SELECT doc_id, round(coalesce(avg(conf) FILTER (conf >= 0), 0), 6) AS confidence FROM ocr_tokens GROUP BY doc_id")
def avg_confidence(s: Source) -> DataFrame:
    return s.ocr_tokens.groupBy("doc_id").agg(F.round(quality.mean_confidence(F.col("conf")), 6).alias("confidence"))
