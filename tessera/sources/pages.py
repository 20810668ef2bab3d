"""Markdown page corpora."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import reading
from tessera.sources.files import source_path


def read_pages(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``[path, body]`` of every matching file below ``root``, paths relative to it."""
    texts = (
        reading(spark).read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
    )
    texts = DataFrame(texts._jdf, spark)
    below = F.regexp_replace(source_path(), r"\A[a-z0-9]+:/*", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return texts.select(F.replace(below, F.lit(prefix), F.lit("")).alias("path"), F.col("value").alias("body"))
