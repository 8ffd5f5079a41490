"""Choice among recognition attempts by confidence.

Attempts are rows page_id, attempt_no, kind (initial, scale, retry), confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD = 70.0
# The retry strategies in order, with the confidence below which each is tried.
STRATEGIES = (("aggressive_denoise", 70.0), ("adaptive_threshold", 60.0), ("morphological_enhance", 50.0), ("super_contrast", 40.0), ("sharpen", 30.0))
MAX_RETRIES = 3
DEFAULT_SCALES = (1.0, 1.5, 2.0)


def ensemble_select(latin: Column, cyrillic: Column, slack: float = 0.05) -> Column:
    return F.when(latin >= cyrillic - slack, "latin").otherwise("cyrillic")


def _best(kind: str) -> Column:
    """Aggregate: the attempt of a kind with the most confidence, the first of equals."""
    item = F.struct("confidence", (-F.col("attempt_no")).alias("n"))
    return F.max(F.when(F.col("kind") == kind, item))


def multiscale_select(attempts: DataFrame, strategy: str = "best_confidence") -> DataFrame:
    """page_id, attempt_no, confidence of the chosen scale. longest goes by text_length, any other name by order."""
    by = {"best_confidence": "confidence", "consensus": "confidence", "longest": "text_length"}.get(strategy)
    place = (-F.col("attempt_no")).alias("n")
    item = F.struct(F.col(by).cast("double").alias("k"), place, "confidence") if by else F.struct(F.lit(0.0).alias("k"), place, "confidence")
    best = attempts.where(F.col("kind") == "scale").groupBy("page_id").agg(F.max(item).alias("b"))
    return best.select("page_id", (-F.col("b.n")).alias("attempt_no"), "b.confidence")


def adaptive_scale(attempts: DataFrame, least: float = GOOD) -> DataFrame:
    """The first attempt if good, else the best scale."""
    both = attempts.groupBy("page_id").agg(_best("initial").alias("i"), _best("scale").alias("s"))
    chosen = F.when(F.col("i.confidence") >= least, F.col("i")).otherwise(F.coalesce("s", F.struct(F.lit(0.0).alias("confidence"), F.lit(None).cast("long").alias("n"))))
    return both.select("page_id", (-chosen["n"]).alias("attempt_no"), chosen["confidence"].alias("confidence"))


def _retries(start: Column, tries: Column) -> Column:
    """Fold over (attempt_no, confidence) in strategy order from start (confidence, attempt_no, n)."""
    triggers = F.array(*[F.lit(t) for _, t in STRATEGIES])

    def step(acc: Column, x: Column) -> Column:
        open_to = (acc["confidence"] < GOOD) & (acc["confidence"] < F.element_at(triggers, x["i"] + 1)) & (acc["n"] < MAX_RETRIES)
        better = open_to & (x["confidence"] > acc["confidence"])
        return F.struct(
            F.when(better, x["confidence"]).otherwise(acc["confidence"]).alias("confidence"),
            F.when(better, x["attempt_no"]).otherwise(acc["attempt_no"]).alias("attempt_no"),
            (acc["n"] + open_to.cast("int")).alias("n"),
        )

    return F.aggregate(tries, start, step)


def _ordered() -> Column:
    """Aggregate: the retry attempts as (i, attempt_no, confidence), one a strategy."""
    tries = F.array_sort(F.collect_list(F.when(F.col("kind") == "retry", F.struct("attempt_no", "confidence"))))
    return F.transform(F.slice(tries, 1, len(STRATEGIES)), lambda x, i: F.struct(i.alias("i"), x["attempt_no"].alias("attempt_no"), x["confidence"].alias("confidence")))


def retry_select(attempts: DataFrame) -> DataFrame:
    """page_id, attempt_no, confidence, n_retries after the retry strategies."""
    own = attempts.groupBy("page_id").agg(_best("initial").alias("b"), _ordered().alias("tries"))
    start = F.struct(F.col("b.confidence").alias("confidence"), (-F.col("b.n")).alias("attempt_no"), F.lit(0).alias("n"))
    done = own.select("page_id", _retries(start, F.col("tries")).alias("r"))
    return done.select("page_id", "r.attempt_no", "r.confidence", F.col("r.n").alias("n_retries"))


def smart_select(attempts: DataFrame) -> DataFrame:
    """First attempt, then the best scale if better, then retries from the first attempt if better; each only below good."""
    own = attempts.groupBy("page_id").agg(_best("initial").alias("b"), _best("scale").alias("s"), _ordered().alias("tries"))
    start = F.struct(F.col("b.confidence").alias("confidence"), (-F.col("b.n")).alias("attempt_no"), F.lit(0).alias("n"))
    steps = own.select("page_id", "b", "s", _retries(start, F.col("tries")).alias("r"))
    scaled = (F.col("b.confidence") < GOOD) & F.coalesce(F.col("s.confidence") > F.col("b.confidence"), F.lit(False))
    second = F.when(scaled, F.struct(F.col("s.confidence").alias("confidence"), (-F.col("s.n")).alias("attempt_no"))).otherwise(
        F.struct(F.col("b.confidence").alias("confidence"), (-F.col("b.n")).alias("attempt_no"))
    )
    steps = steps.select("page_id", second.alias("m"), "r")
    retried = (F.col("m.confidence") < GOOD) & (F.col("r.confidence") > F.col("m.confidence"))
    pick = lambda c: F.when(retried, F.col(f"r.{c}")).otherwise(F.col(f"m.{c}")).alias(c)
    return steps.select("page_id", pick("attempt_no"), pick("confidence"))


def retry_plan(attempts: DataFrame) -> DataFrame:
    """page_id, strategy: those whose trigger the first attempt's confidence is below. The five strategies are an array."""
    names = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(t).alias("trigger")) for n, t in STRATEGIES])
    due = F.filter(names, lambda s: (F.col("confidence") < GOOD) & (F.col("confidence") < s["trigger"]))
    return attempts.where(F.col("kind") == "initial").select("page_id", F.explode(due).alias("s")).select("page_id", "s.strategy")


def scale_topk(history: DataFrame, types: DataFrame, k: int = 3) -> DataFrame:
    """doc_type, scales: the k best by mean confidence, the first recorded of equals; defaults without history.

    history is doc_type, scale, confidence, seq.
    """
    means = history.groupBy("doc_type", "scale").agg(F.avg("confidence").alias("mean"), F.min("seq").alias("first"))
    ranked = means.groupBy("doc_type").agg(F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), "first", "scale"))).alias("all"))
    scales = ranked.select("doc_type", F.transform(F.slice("all", 1, k), lambda x: x["scale"]).alias("scales"))
    return types.join(scales, "doc_type", "left").select("doc_type", F.coalesce("scales", F.array(*map(F.lit, DEFAULT_SCALES))).alias("scales"))
