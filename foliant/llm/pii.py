"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import give_back, materialize, small_batches

# The patterns of the contract, as parts that never read a run of characters twice. An address is found
# from its @: the domain after it, then the local part before it, back to the end of the last match. A match of
# numbers with dots cannot begin inside a run of digits whose beginning failed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")

#: Whole runs in which the patterns of numbers can match: matches never cross the ends of such a run.
NUMBER_RUN = re.compile(r"\+?[0-9][0-9\x20().+-]*")

#: Candidates of the further kinds, before any labeler votes.
EXTRA = {
    "obfuscated": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ -])[0-9]{3}[ -][0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
KINDS = (*BASE, *EXTRA)

LABELERS = ("shape", "gazetteer", "context", "negative")


@dataclass(frozen=True)
class Tables:
    """What labelers look up: words before a span that speak for a kind or against any, last labels of hosts, countries.

    They only vote; how far each vote counts is estimated from the documents.
    """

    context: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "email": ("mail", "email", "e-mail", "contact", "write"),
            "ip": ("ip", "host", "server", "address", "from"),
            "card": ("card", "visa", "credit", "paid", "payment"),
            "phone": ("phone", "tel", "call", "mobile", "fax"),
            "obfuscated": ("mail", "email", "e-mail", "contact", "write"),
            "national_id": ("ssn", "social", "security", "id", "insurance"),
            "local_phone": ("phone", "tel", "call", "mobile", "fax"),
            "account": ("iban", "account", "bank", "transfer", "konto"),
        }
    )
    against: tuple[str, ...] = ("version", "isbn", "section", "page", "chapter", "order")
    hosts: tuple[str, ...] = ("com", "net", "org", "edu", "gov", "info", "de", "fr", "es", "uk")
    countries: tuple[str, ...] = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "NO", "PL", "PT", "SE")


#: Values that each feature of a span has: its length, its share of digits, what stands before and after it, case and place.
FEATURES = (4, 3, 4, 4, 2)
CANDIDATES = "array<struct<kind:string,start:int,end:int,votes:array<int>,features:array<int>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans as (kind, start, end), by kind, then start, in time linear in the text."""
    found: dict[str, list] = {k: [] for k in BASE}
    found["email"] += _addresses(text)
    for run in NUMBER_RUN.finditer(text):
        at, piece = run.start(), run[0]
        if len(piece) < 7:
            continue
        for m in IP.finditer(piece):
            if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found["ip"].append((at + m.start(), at + m.end()))
        for m in CARD.finditer(piece):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append((at + m.start(), at + m.end()))
        for m in PHONE.finditer(piece):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append((at + m.start(), at + m.end()))
    return [(k, a, b) for k in BASE for a, b in found[k]]


def _votes(text: str, kind: str, start: int, end: int, tables: Tables) -> list[int]:
    """Each labeler's vote: 1 for, -1 against, 0 abstains."""
    span = text[start:end]
    near = {w.strip(".,:;!?()") for w in text[max(0, start - 60) : start].lower().split()[-4:]}
    digits = re.sub(r"[^0-9]", "", span)
    shapes = {
        "email": lambda: ".." not in span and len(span) <= 254,
        "obfuscated": lambda: len(span) <= 254,
        "ip": lambda: not span.startswith(("0.", "255.")),
        "card": lambda: 12 < len(digits) < 20 and luhn(digits),
        "phone": lambda: len(digits) >= 10,
        "national_id": lambda: not (digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000"),
        "local_phone": lambda: len(digits) == 10 and digits[0] not in "01",
        "account": lambda: 15 <= len(span.replace(" ", "")) <= 34 and _iban(span.replace(" ", "")),
    }
    shape = shapes[kind]()
    listed = {
        "email": lambda: span.rpartition(".")[2].lower() in tables.hosts,
        "obfuscated": lambda: re.split(r"[^a-z]+", span.lower().rstrip(")] "))[-1] in tables.hosts,
        "account": lambda: span[:2] in tables.countries,
        "card": lambda: digits[:1] in tuple("3456"),
    }.get(kind, lambda: None)()
    flat = len(set(digits)) <= 2 and len(digits) > 4
    return [1 if shape else -1, 0 if listed is None else (1 if listed else -1), 1 if near & set(tables.context[kind]) else 0, -1 if flat or set(tables.against) & near else 0]


def _features(text: str, start: int, end: int) -> list[int]:
    """The span itself and its neighbours, as FEATURES counts their values."""
    span = text[start : min(end, start + 64)]
    beside = lambda c: 0 if not c or c == "\n" else 1 if c.isspace() else 2 if c.isalnum() else 3
    share = sum(c.isdigit() for c in span) / len(span)
    return [
        min(3, (end - start) // 10),
        0 if share == 0 else 1 if share < 0.6 else 2,
        beside(text[start - 1 : start]),
        beside(text[end : end + 1]),
        int(span.lower() != span),
    ]


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str, tables: Tables | None = None) -> list[tuple[str, int, int, list[int], list[int]]]:
    """Base spans and those of further kinds that no span before them overlaps, with their votes and features."""
    tables = tables or Tables()
    spans = base_spans(text)
    more = []
    if "[at]" in text or "(at)" in text or "[AT]" in text or "(AT)" in text:
        more += [("obfuscated", *m.span()) for m in EXTRA["obfuscated"].finditer(text)]
    if any(len(r[0]) >= 9 for r in NUMBER_RUN.finditer(text)):
        more += [(k, *m.span()) for k in ("national_id", "local_phone", "account") for m in EXTRA[k].finditer(text)]
    starts: list[int] = []  # of what is taken: spans apart from each other, in order
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for k, a, b in more:
        i = bisect_right(ends, a)
        if i == len(ends) or starts[i] >= b:
            spans.append((k, a, b))
            starts.insert(i, a)
            ends.insert(i, b)
    return [(k, a, b, _votes(text, k, a, b, tables), _features(text, a, b)) for k, a, b in spans]


def _inputs(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """What the classifier sees: a constant, votes for and against, and one column for each value of each feature."""
    return np.hstack([np.ones((len(votes), 1)), votes > 0, votes < 0, *[features[:, [i]] == np.arange(n) for i, n in enumerate(FEATURES)]]).astype(float)


def fit(patterns: list[tuple[str, list[int], list[int], int]], rounds: int = 30) -> dict[str, list[float]]:
    """Weights of the span classifier for each kind.

    patterns: (kind, votes, features, number of spans). The votes' reliabilities and the share of true spans are found
    by expectation-maximisation over the votes alone; a logistic regression on the expected labels then weighs the
    votes together with the span's own features, so spans with the same votes can part.
    """
    out = {}
    for kind in KINDS:
        own = [(v, f, n) for k, v, f, n in patterns if k == kind]
        if not own:
            continue
        votes, features, n = np.array([v for v, _, _ in own]), np.array([f for _, f, _ in own]), np.array([float(m) for _, _, m in own])
        right, wrong, share = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.3), 0.7
        for _ in range(rounds):
            odds = np.log(share / (1 - share)) + (np.where(votes > 0, np.log(right / wrong), 0) + np.where(votes < 0, np.log((1 - right) / (1 - wrong)), 0)).sum(1)
            true = 1 / (1 + np.exp(-odds))
            cast = votes != 0
            # A prior of ten spans keeps labelers better than chance and the estimates off 0 and 1.
            right = ((n * true) @ (votes > 0) + 8) / ((n * true) @ cast + 10)
            wrong = np.minimum(((n * (1 - true)) @ (votes > 0) + 3) / ((n * (1 - true)) @ cast + 10), right - 0.05)
            share = float(np.clip((n @ true + 7) / (n.sum() + 10), 0.02, 0.98))
        x = _inputs(votes, features)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (p - true)) + w
            w -= np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)), slope)
        out[kind] = w.tolist()
    return out


def accepted(model: dict[str, list[float]], kind: str, votes: list[int], features: list[int]) -> bool:
    """Base spans always stay; others if the classifier gives them more than a half."""
    if kind in BASE:
        return True
    w = model.get(kind)
    return w is not None and float((_inputs(np.array([votes]), np.array([features])) @ np.array(w))[0]) > 0


def candidate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """Per input row doc_id and its candidates; null and empty texts have none, repeated rows each have their own."""
    tables = tables or Tables()
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "votes": v, "features": f} for k, s, e, v, f in candidates(t, tables)] if t else [] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": found})
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, f"doc_id {kind}, found {CANDIDATES}")


def fit_rows(rows: DataFrame) -> dict[str, list[float]]:
    """The classifier from all candidates. Only counts are collected: of the patterns of votes and features that occur,
    at most 8 kinds x 81 x 384, in practice some hundreds."""
    counts = rows.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    return fit(sorted((r["kind"], list(r["votes"]), list(r["features"]), r["count"]) for r in counts.collect()))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of the base spans and all spans as text."""
    rows = materialize(candidate_rows(docs))
    model = fit_rows(rows)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for found in b["found"]:
                kept = [(KINDS.index(c["kind"]), c["start"], c["end"]) for c in found if accepted(model, c["kind"], list(c["votes"]), list(c["features"]))]
                kept.sort()
                text = [f"{KINDS[k]}:{s}:{e}" for k, s, e in kept]
                base = ",".join(text[: sum(k < len(BASE) for k, _, _ in kept)])
                out.append([*[sum(k == i for k, _, _ in kept) for i in range(len(BASE))], hashlib.sha256(base.encode()).hexdigest(), ",".join(text)])
            yield pd.concat([b[["doc_id"]], pd.DataFrame(out, columns=[*[f"n_{k}" for k in BASE], "base_sha256", "spans"])], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(tell, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """docs with every accepted span of the text replaced by its kind in angle brackets; null stays null."""
    tables = tables or Tables()
    model = fit_rows(materialize(candidate_rows(docs.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col, tables)))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: redacted(t, model, tables) if t else t)
        give_back()
        return out

    return docs.withColumn(text_col, clean(text_col))


def redacted(text: str, model: dict[str, list[float]], tables: Tables | None = None) -> str:
    """The text without accepted spans, read again until there is none: a cut can complete a span beside it."""
    while True:
        spans = sorted((s, -e, k) for k, s, e, v, f in candidates(text, tables) if accepted(model, k, v, f))
        if not spans:
            return text
        out, at = [], 0
        for s, e, k in spans:
            if s >= at:
                out += [text[at:s], f"<{k.upper()}>"]
            at = max(at, -e)
        text = "".join([*out, text[at:]])
