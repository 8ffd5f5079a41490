"""Secret scan over a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize, sparse_join, text_or_empty
from foliant.llm.trigrams import trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: code points that the group must have, or the match fails without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The patterns of the contract, then those of the further kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url", r"[a-z]{3,10}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._!-]{6,64}@[A-Za-z0-9.-]{3,}"),
)


SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _holds(query, words: dict[str, Column]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return words[query]
    parts = [_holds(q, words) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind order, kind, end), in code points, of one rule's matches.

    The pieces between the matches and the matches come from the same expression, so they alternate; running
    sums of their lengths are the places.
    """
    pattern = F.lit(rule.java)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.java, -1), F.lit(1), F.size(matches))
    triples = F.arrays_zip(gaps.alias("a"), matches.alias("b"), group.alias("c"))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["off"] + F.length(x["a"])
        end = start + F.length(x["b"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("off"), F.when(F.length(x["c"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("off"), empty.alias("out"))
    return F.aggregate(triples, start, step, lambda acc: acc["out"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every input row with ``doc_id`` and ``found``: its secrets as (start, kind_no, kind, end) by start, then kind.

    Index: one posting (trigram, row) for each trigram that some rule's query asks for and that the lower-cased
    text holds. Grouping the postings by row intersects the lists; the Boolean queries on the result name the
    (row, rule) candidates, which the regular expressions verify; of the texts only those of candidates are shuffled. A rule without mandatory trigrams reads all
    texts. Rows are known by a hash of id and text: repeated rows and null ids each keep their own result, and a
    collision could only add candidates. Null and empty texts have no secrets.
    """
    needs = [trigram_query(r.pattern) for r in rules]
    asked = sorted(set().union(*map(trigrams, needs)))
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    # The lambda's variable keeps the lower-cased text; written out, it would be worked out for every trigram.
    of = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(asked)]))
    held = base.select("row_key", F.transform(F.array(F.lower("text")), of)[0].alias("held"))
    postings = held.select("row_key", F.explode("held").alias("trigram"))
    masks = [F.expr(f"bit_or(if(trigram div 60 = {k}, shiftleft(1L, trigram % 60), 0L))").alias(f"mask_{k}") for k in range(-(-len(asked) // 60))]
    rows = postings.groupBy("row_key").agg(*masks)
    words = {t: F.col(f"mask_{i // 60}").bitwiseAND(F.lit(1 << i % 60)) != 0 for i, t in enumerate(asked)}
    picked = [i for i, q in enumerate(needs) if q is not True]
    chosen = reduce(Column.bitwiseOR, [F.when(_holds(needs[i], words), F.lit(1 << i)).otherwise(F.lit(0)) for i in picked])
    candidates = materialize(rows.select("row_key", chosen.alias("chosen")).where("chosen != 0"))
    joined = sparse_join(base, candidates, "row_key")
    open_to = lambda i, q: F.lit(True) if q is True else F.coalesce(F.col("chosen"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
    none = F.array().cast(SPANS)
    found = [F.when(open_to(i, q) & F.col("text").rlike(r.java), _spans(F.col("text"), r, i)).otherwise(none) for i, (q, r) in enumerate(zip(needs, rules, strict=True))]
    return joined.select("doc_id", "text", F.sort_array(F.flatten(F.array(*found))).alias("found"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    found = secret_spans(docs, rules=rules)
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(span_text(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
    )
