"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import frequent, give_back, materialize, small_batches, spread_join, text_or_empty

BUCKETS = 1 << 16
#: Letter triples that a text needs to have a language at all; one letter between spaces is one.
LEAST_LETTERS = 1
#: Characters scored at once; a text is cut into such parts, which overlap by two, and all are scored.
PART = 1 << 20

# Country endings of addresses and the language that they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en"}


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the letter triples of the whole text, part by part; runs without letters count as one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    for at in range(0, max(len(codes) - 2, 1), PART):
        c = codes[at : at + PART + 2]
        c = np.where(((c >= 97) & (c <= 122)) | ((c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ((c < 0x2000) | (c > 0x303F))), c, np.uint32(32))
        c = c[~((c == 32) & (np.concatenate([[1], c[:-1]]) == 32))]
        if (c != 32).any() and len(c) >= 3:
            yield (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


@dataclass
class Profiles:
    """Log likelihoods of the triples: one row a bucket, one column a language."""

    langs: list[str]
    table: np.ndarray
    #: Weight of a triple's log likelihood. Below 1, whole texts of any size speak less loudly than other evidence.
    temper: float = 1.0

    def score(self, text: str) -> tuple[int, np.ndarray]:
        n, total = 0, np.zeros(len(self.langs))
        for g in _grams(text):
            n += len(g)
            total += self.table[g].sum(axis=0, dtype=np.float64)
        return n, total * self.temper


def fit_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, most_langs: int = 64, temper: float = 1.0) -> Profiles:
    """Profiles from at most `sample` labelled rows: those with the smallest hash of id and language.

    Whole texts of the sample are counted on the executors; the driver gets counts, at most BUCKETS a language. Of the
    sample's labels the most_langs most frequent, then by name, have a profile. Of equal rows no more are taken than
    sample leaves. Rows without label or text are left out; without any labelled row there is no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col), F.col(lang_col)).alias("h"), F.lower(F.trim(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    least = rows.select("h").orderBy("h").limit(sample)
    limit, n = least.agg(F.max("h"), F.count(F.lit(1))).first()
    if limit is not None:
        below = least.where(F.col("h") < limit).count()
        rows = materialize(rows.where(F.col("h") < limit).unionByName(rows.where(F.col("h") == limit).limit(n - below)).select("lang", "text"))
        langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()]
        rows = rows.where(F.col("lang").isin(langs))
    else:
        return Profiles([], np.zeros((BUCKETS, 0), dtype=np.float32))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for g in _grams(text):
                    sums[lang] = sums.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.05)
    table[got["bucket"], got["lang"].map(langs.index)] += got["n"]
    return Profiles(langs, np.log(table / table.sum(axis=0)).astype(np.float32), temper)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def evidence(docs: DataFrame, profiles: Profiles, text: Column, declared: Column, suffix: Column, host: Column, carried: list[str | Column]) -> DataFrame:
    """The carried columns, host, declared and suffix as known languages or "other" or "none", letters and text posterior."""
    known = [F.lit(x) for x in profiles.langs]
    named = lambda c: F.when(c.isNull() | (c == ""), "none").when(c.isin(*known) if known else F.lit(False), c).otherwise("other")
    first = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]{2,3})", 1))
    ready = docs.select(*carried, F.coalesce(host, F.lit("")).alias("host"), named(first(declared)).alias("declared"), named(suffix).alias("suffix"), text.alias("text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scored = [profiles.score(t) for t in b["text"]]
            likely = _soft(np.array([s for _, s in scored]).reshape(len(b), -1)) if profiles.langs else np.zeros((len(b), 0))
            yield b.drop(columns="text").assign(letters=[n for n, _ in scored], likely=list(likely))
            give_back()

    small_batches(docs.sparkSession)
    plain = ready.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return ready.mapInPandas(score, f"{schema}, letters long, likely array<double>")


def fuse(rows: DataFrame, langs: list[str], weight: float = 20.0, least: float = 0.5) -> DataFrame:
    """rows of evidence() with lang, confidence and accepted.

    Declared languages and suffixes count by how they go with the texts' languages over all rows (tables of at
    most (languages + 2) x languages). A row's host prior is the sum of the text posteriors of the host's other rows,
    smoothed by weight rows of its domain's prior, that of the domain's other rows by the whole corpus's. Hosts with many rows are joined by broadcast (at most 512),
    the others by shuffle. A row without letters is "und" and not accepted; so is one with no language over least.
    """
    if not langs:
        return rows.drop("likely").withColumns({"lang": F.lit("und"), "confidence": F.lit(0.0), "accepted": F.lit(False)})
    rows = materialize(rows)
    n = len(langs)
    seen = rows.where(F.col("letters") >= LEAST_LETTERS)
    sums = [F.sum(F.col("likely")[i]).alias(f"s{i}") for i in range(n)]
    total = np.array([float(x or 0) for x in seen.agg(*sums).collect()[0]]) + 1.0
    overall = total / total.sum()
    tables = {}
    for column in ("declared", "suffix"):
        got = {r[0]: np.array(r[1:], dtype=float) for r in seen.groupBy(column).agg(*sums).collect()}
        base = {v: got.get(v, np.zeros(n)) + 1.0 for v in (*langs, "other", "none")}
        whole = sum(base.values())
        tables[column] = {v: np.log(x / whole) for v, x in base.items()}

    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = seen.groupBy("host").agg(*sums).withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    each = lambda p: F.array(*[F.col(f"{p}{i}") for i in range(n)])
    priors = materialize(hosts.join(domains, "domain").select("host", each("s").alias("of_host"), each("d").alias("of_domain")))
    none = F.array(*[F.lit(0.0)] * n)
    counted = spread_join(seen, priors, "host", frequent(seen.select("host"), "host"))
    rest = rows.where(F.col("letters") < LEAST_LETTERS).withColumns({"of_host": none, "of_domain": none})

    def decide(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            likely = np.stack(b["likely"].to_list())
            own = likely * (b["letters"] >= LEAST_LETTERS).to_numpy()[:, None]
            of_domain, of_host = (np.maximum(np.stack(b[c].to_list()) - own, 0) for c in ("of_domain", "of_host"))
            up = (of_domain + weight * overall) / (of_domain.sum(axis=1, keepdims=True) + weight)
            prior = (of_host + weight * up) / (of_host.sum(axis=1, keepdims=True) + weight)
            score = np.log(np.maximum(likely, 1e-30)) + np.log(prior)
            for column, table in tables.items():
                score += np.stack([table[v] for v in b[column]])
            p = _soft(score)
            top = p.argmax(axis=1)
            ok = (b["letters"] >= LEAST_LETTERS).to_numpy() & (p.max(axis=1) >= least)
            yield b[names].assign(lang=np.where(ok, np.array(langs, dtype=object)[top], "und"), confidence=np.round(p.max(axis=1), 6), accepted=ok)
            give_back()

    carried = [c for c in rows.columns if c != "likely"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carried).schema)
    whole = counted.select(*rows.columns, "of_host", "of_domain").unionByName(rest.select(*rows.columns, "of_host", "of_domain"))
    return whole.mapInPandas(partial(decide, names=carried), f"{schema}, lang string, confidence double, accepted boolean")


def identify_documents(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """Per document doc_id, host, declared, suffix, letters, lang, confidence, accepted.

    The host is the source, the declared language the lang column, which labels the sample too; documents have no
    address, so their suffix is "none". Null texts count as empty; repeated rows each get a row.
    """
    profiles = fit_profiles(docs, sample=sample)
    rows = evidence(docs, profiles, text_or_empty(), F.col("lang"), F.lit(None).cast("string"), F.col("source"), ["doc_id"])
    return fuse(rows, profiles.langs)


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, and of the markup: text, declared language; of the address: host, suffix."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]{1,10};", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))
    country = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.regexp_extract(host, r"([a-z]+)$", 1))
    folder = F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+/([a-z]{2})(?:/|$)", 1), F.lit(""))
    declared = F.regexp_extract(html, r"""(?is)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return pages.select("page_id", "url", text.alias("text"), declared.alias("declared"), host.alias("host"), F.coalesce(country, folder).alias("suffix"))


def identify_pages(pages: DataFrame, labelled: DataFrame, sample: int = 4000) -> DataFrame:
    """Per page page_id, host, declared, suffix, letters, lang, confidence, accepted; profiles come from labelled documents."""
    profiles = fit_profiles(labelled, sample=sample)
    parts = page_parts(pages)
    return fuse(evidence(parts, profiles, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), ["page_id"]), profiles.langs)
