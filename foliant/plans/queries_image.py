"""Queries over page images; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import quality
from foliant.operators import images
from foliant.plans.queries import Source, query


def drawn(s: Source) -> DataFrame:
    """A small gray image for each page: the first bytes of a digest chain, 16 x 16."""
    blocks = F.concat(*[F.unhex(F.sha2(F.concat(F.col("url"), F.lit(str(i))), 256)) for i in range(8)])
    return s.pages.select("page_id", F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("channels"), blocks.alias("data"))


@query()
def image_metrics(s: Source) -> DataFrame:
    own = images.image_metrics(drawn(s), "page_id")
    return own.select("page_id", *[F.round(m, 6).alias(m) for m in images.METRICS], "error")


@query()
def image_preprocess(s: Source) -> DataFrame:
    score = quality.quality_score(*[F.col(m) for m in images.METRICS])
    tiers = images.image_metrics(drawn(s), "page_id").select("page_id", quality.quality_tier(score).alias("tier"))
    done = images.preprocess(drawn(s).join(tiers, "page_id"), "page_id")
    return done.select("page_id", "height", "width", F.sha2("data", 256).alias("data_sha256"))


@query()
def image_retry(s: Source) -> DataFrame:
    """Each page under the filter of a further attempt."""
    names = F.array(*map(F.lit, images.RETRIES))
    asked = drawn(s).withColumn("filter", F.get(names, (F.col("page_id") % len(images.RETRIES)).cast("int")))
    done = images.preprocess(asked, "page_id", "filter", images.RETRIES, "denoise")
    return done.select("page_id", "height", "width", F.sha2("data", 256).alias("data_sha256"))


@query()
def image_regions(s: Source) -> DataFrame:
    return images.regions(drawn(s), "page_id")


@query()
def embed_documents(s: Source) -> DataFrame:
    own = images.embed(s.documents, "doc_id", "text", images.HashEncoder)
    return own.select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squares"))
