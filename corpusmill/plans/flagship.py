
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.select import shortest_n
from corpusmill.operators.think import think_stats
from corpusmill.operators.validate import drop_incomplete_qa, format_qa, route_format
from corpusmill.plans.fixtures import view

FLAGSHIP_N = 100


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "samples")
    kept = drop_incomplete_qa(route_format(samples)).filter("kind = 'qa'")
    short = shortest_n(kept, FLAGSHIP_N, cols=("solution",), tie="sample_id")
    return think_stats(format_qa(short), text="text")
