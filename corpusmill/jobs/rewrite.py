"""Rewrite job: select -> save originals -> rewrite -> accept -> save.

spark-submit --py-files corpusmill.zip corpusmill/jobs/rewrite.py --input PATH --format parquet \
    --name org/dataset --split train --out OUT --n 1000 \
    --lexicon LEXICON_PARQUET | --transformer pkg.module:factory
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill.jobs.common import load_object, load_table
from corpusmill.operators.rewrite import (apply_verdict, choose_candidate, gain_of_lengths, lexicon_attempts,
                                          load_system_prompt, rewrite_report, run_rewrite)
from corpusmill.operators.select import shortest_n
from corpusmill.operators.validate import REQUIRED_QA, missing_columns, rewritable
from corpusmill.session import get_session, scratch_scope, scratch_table
from corpusmill.sources.datasets import observed_manifest, outcome_counts, write_original, write_rewritten

log = logging.getLogger("corpusmill.rewrite")


def main(argv=None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="parquet")
    p.add_argument("--schema")
    p.add_argument("--name", required=True)
    p.add_argument("--split", default="train")
    p.add_argument("--subset")
    p.add_argument("--out", required=True)
    p.add_argument("--n", type=int)
    p.add_argument("--key", default="sample_id")
    p.add_argument("--lexicon")
    p.add_argument("--transformer")
    p.add_argument("--system-prompt")
    p.add_argument("--max-retries", type=int, default=3)
    p.add_argument("--max-concurrent", type=int, default=5)
    p.add_argument("--retry-delay", type=float, default=1.0)
    a = p.parse_args(argv)
    if not (a.lexicon or a.transformer):
        p.error("--lexicon or --transformer is needed")

    spark = get_session()
    with scratch_scope(spark):
        run(spark, a)


def run(spark, a) -> None:
    df = load_table(spark, a.input, a.format, a.schema)
    missing = missing_columns(df, REQUIRED_QA)
    if missing:
        log.warning("missing columns %s; available %s", missing, df.columns)
    # counts are taken from the writes, in their last stage
    read, chosen, outcomes = Observation("read"), Observation("chosen"), Observation("outcomes")
    picked = shortest_n(df, a.n, cols=("solution",), tie=a.key, observed=read)
    selected = scratch_table(picked.observe(chosen, F.count(F.lit(1)).alias("n")), "selected")
    n_rows = chosen.get.get("n") or 0
    original = write_original(selected, a.out, a.name, a.split, a.subset, n_rows)

    todo = selected.filter(rewritable())
    if a.transformer:
        attempts = run_rewrite(todo, load_object(a.transformer)(), f"{a.out}/attempt_log",
                               max_retries=a.max_retries, max_concurrent=a.max_concurrent,
                               retry_delay=a.retry_delay, system=load_system_prompt(a.system_prompt), key=a.key)
    else:
        attempts = lexicon_attempts(todo, spark.read.parquet(a.lexicon), key=a.key)
        attempts.write.mode("overwrite").parquet(f"{a.out}/attempt_log")
        attempts = spark.read.parquet(f"{a.out}/attempt_log")
    verdicts = scratch_table(choose_candidate(selected, attempts, a.max_retries, key=a.key, with_original=False), "verdicts")
    rewritten = apply_verdict(selected, verdicts, key=a.key).observe(outcomes, *outcome_counts())
    rewritten_path = write_rewritten(rewritten, a.out, a.name, a.split, a.subset, n_rows)

    gain = F.when(F.col("outcome") == "rewritten", gain_of_lengths("orig_len", F.length("chosen")))
    rewrite_report(verdicts.select("outcome", "n_calls", gain.alias("gain"))).write.mode("overwrite").parquet(f"{a.out}/report")
    observed_manifest(spark, outcomes, n_input=read.get.get("n_input") or 0, original_path=original,
                      rewritten_path=rewritten_path, columns="solution", model=a.transformer or "lexicon") \
        .write.mode("overwrite").json(f"{a.out}/manifest")


if __name__ == "__main__":
    main()
