"""Derived views over the test tables, in one SQL text for Spark and for DuckDB.

``@DIV@`` is integer division; all other functions mean the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.tables import table

NL = "chr(10)"
S = "cast({} as string)".format

VIEWS: dict[str, tuple[str, str]] = {
    "noisy_documents": (
        "documents",
        f"""SELECT doc_id, concat(
          '№ ', {S("doc_id % 97 + 1")}, '/', {S("2015 + doc_id % 10")}, {NL},
          lpad({S("doc_id % 28 + 1")}, 2, '0'), '.', lpad({S("doc_id % 12 + 1")}, 2, '0'), '.', {S("2015 + doc_id % 10")}, ' notice', {NL},
          case when doc_id % 3 = 0 then translate(text, 'aeopcyx', 'аеорсух')
               when doc_id % 3 = 1 then concat(translate(substr(text, 1, length(text) @DIV@ 2), 'aeopcyx', 'аеорсух'), substr(text, length(text) @DIV@ 2 + 1))
               else text end, {NL},
          case when doc_id % 5 < 2 then 'тсий кларвд минул йога фбит тсий кларвд минул йога фбит тсий кларвд минул йога фбит тсий' else '' end, {NL},
          'доку-', {NL}, 'мент O', {S("doc_id % 10")}, ' 1', {S("doc_id % 10")}, 'O 1,000 , тел .:x 1,000,000', {NL},
          'A   B   C', {NL}, 'D   E   F   G', {NL}, 'x', {NL}, 'after  the table', {NL},
          'REPUBLIC OF EXAMPLES OFFICIAL GAZETTE', {NL}, 'Иш loyiha l vv rn 0 well l0 o''zbek g''oya this', {NL},
          case when doc_id % 2 = 0 then concat('Watermark of the press', {NL}, 'ok', {NL}, 'watermark  of the press', {NL}, 'Watermark of the press', {NL}, 'Watermark of the press', {NL}) else '' end,
          case when doc_id % 4 = 1 then concat('### --- ### --- ### ab', {NL}, 'QWERTYU ASDFGHJ ZXCVBNM kept', {NL}, 'ab ab ab ab cd cd cd cd ef ef ef ef', {NL}) else '' end,
          {NL}, {NL}, {NL}, '" quoted "', {NL}, '===', {NL}, 'tail 10 and 1 one') AS text
        FROM documents""",
    ),
    "regions": (
        "events",
        """SELECT event_id AS region_id, event_id % 200 AS page_id, 2400 AS page_w, 3200 AS page_h,
          40 + ((event_id @DIV@ 200) % (1 + (event_id % 200) % 4)) * 600 + event_id % 17 AS x,
          20 + (event_id @DIV@ 800) * 250 + (event_id * 7) % 40 AS y, 420 + event_id % 90 AS w, 60 + (event_id * 13) % 160 AS h,
          case when event_id % 11 = 0 then '  ' else concat('r', cast(event_id as string)) end AS text FROM events""",
    ),
    "boxes": (
        "events",
        """SELECT event_id AS region_id, event_id % 200 AS page_id, 1200 AS page_w, 1600 AS page_h,
          (event_id * 31) % 900 - 20 AS x1, (event_id * 17) % 1500 - 10 AS y1,
          (event_id * 31) % 900 - 20 + 20 + (event_id * 7) % 900 AS x2, (event_id * 17) % 1500 - 10 + 5 + (event_id * 3) % 260 AS y2,
          case when event_id % 5 = 0 or event_id % 200 < 20 then 'header' else 'body' end AS name FROM events""",
    ),
    "attempts": (
        "events",
        """SELECT event_id @DIV@ 8 AS page_id, event_id % 8 AS attempt_no,
          case when event_id % 8 = 0 then 'initial' when event_id % 8 < 3 then 'scale' else 'retry' end AS kind,
          (event_id * 7919 % 10001) / 100.0e0 AS confidence, (event_id * 31) % 500 AS text_length FROM events""",
    ),
    "page_metrics": (
        "documents",
        """SELECT doc_id, (doc_id * 37) % 1500 AS lap_var, (doc_id * 13) % 90 AS std, ((doc_id * 7) % 120) / 1000.0e0 AS edge_density,
          (doc_id * 11) % 30 AS noise, (doc_id * 3) % 100 AS min_val, 155 + (doc_id * 5) % 101 AS max_val FROM documents""",
    ),
    "font_spans": ("events", "SELECT event_id % 1200 AS doc_id, 6 + (event_id * 31) % 14 AS size, event_id % 1200 % 7 = 0 AS has_image FROM events WHERE event_id % 1200 % 9 <> 0 AND event_id % 3 <> 1"),
    "separator_lines": (
        "events",
        """SELECT event_id AS line_id, event_id % 100 AS page_id, event_id % 50 AS x1, (event_id * 37) % 3000 AS y1,
          case when event_id % 11 = 0 then event_id % 50 else event_id % 50 + 500 end AS x2,
          (event_id * 37) % 3000 + case when event_id % 5 = 0 then 400 else event_id % 30 end AS y2 FROM events""",
    ),
    "uploads": (
        "events",
        """SELECT event_id AS id, case when event_id % 5 = 0 then 'text/plain' when event_id % 17 = 1 then null else 'application/pdf' end AS content_type,
          case when event_id % 7 = 0 then 0 when event_id % 7 = 1 then 26214401 when event_id % 7 = 2 then 26214400 else event_id * 100 end AS size_bytes,
          concat('"C:', chr(92), chr(92), 'scans', chr(92), 'f', cast(event_id as string), case when event_id % 3 = 0 then '.pdf" ' else '.png" ' end) AS file_path FROM events""",
    ),
    "ocr_results": (
        "documents, events",
        """SELECT d.doc_id AS id, concat('doc_', cast(d.doc_id as string), '.pdf') AS filename, d.text AS text,
          case when d.doc_id % 17 = 0 then null else d.doc_id % 5 + 1 end AS pages, case when d.doc_id % 13 = 0 then null else d.doc_id % 3 + 1 end AS columns,
          d.n_chars AS characters, case when d.doc_id % 19 = 0 then null else (d.doc_id % 400) / 10.0e0 end AS processing_time,
          case when d.doc_id % 4 = 0 then null else e.user_id % 25 end AS user_id, e.ts AS created_at
        FROM documents d JOIN events e ON d.doc_id = e.event_id""",
    ),
}

#: Views whose rows come from taking an array apart, which the engines write differently.
UNNESTED = {
    "ocr_tokens": (
        "documents",
        "SELECT doc_id, pos, text, {conf} AS conf FROM (SELECT doc_id, {pos} AS pos, {word} AS text FROM {source})",
        "case when (doc_id + pos) % 10 = 0 then -1.0e0 else ((doc_id * 7919 + pos * 104729) % 10001) / 100.0e0 end",
    )
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "ocr_tokens":
        body, conf = UNNESTED[name][1:]
        sql = body.format(conf=conf, pos="cast(p as bigint)", word="w", source="documents LATERAL VIEW posexplode(split(text, ' ')) v AS p, w")
        needs = ["documents"]
    else:
        needs, sql = VIEWS[name][0].split(", "), VIEWS[name][1].replace("@DIV@", "div")
    for t in needs:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def duck(name: str) -> str:
    """The view as a common table expression for DuckDB."""
    if name == "ocr_tokens":
        body, conf = UNNESTED[name][1:]
        words = "(SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents)"
        return f"{name} AS ({body.format(conf=conf, pos='p', word='w', source=words)})"
    return f"{name} AS ({VIEWS[name][1].replace('@DIV@', '//')})"
