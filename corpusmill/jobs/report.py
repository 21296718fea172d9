"""Corpus report: think-tag statistics (overall and per group), coverage
gate, special-token audit and token-length profile.

spark-submit --py-files corpusmill.zip corpusmill/jobs/report.py --input PATH --out OUT [--by lang]
    [--settings FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpusmill.jobs.common import load_table
from corpusmill.functions.tokens import tokenize
from corpusmill.operators.batches import length_profile
from corpusmill.operators.think import coverage_gate, pick_text_field, think_stats, think_stats_by
from corpusmill.operators.vocab import token_audit
from corpusmill.session import get_session
from corpusmill.settings import load_settings


def main(argv=None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="parquet")
    p.add_argument("--schema")
    p.add_argument("--out", required=True)
    p.add_argument("--by", action="append", default=[])
    p.add_argument("--min-coverage", type=float)
    p.add_argument("--settings", help="YAML/JSON settings file")
    a = p.parse_args(argv)
    cfg = load_settings(a.settings)
    tags = (cfg.think_start, cfg.think_end)

    spark = get_session()
    df = load_table(spark, a.input, a.format, a.schema)
    text = df.withColumn("_text", pick_text_field(df))
    think_stats(df, tags=tags).write.mode("overwrite").json(f"{a.out}/think_stats")
    if a.by:
        think_stats_by(df, a.by, tags=tags).write.mode("overwrite").json(f"{a.out}/think_stats_by")
    coverage_gate(text, cfg.think_coverage if a.min_coverage is None else a.min_coverage, text="_text", tags=tags).write.mode("overwrite").json(f"{a.out}/coverage")
    token_audit(text, "_text", cfg.remove_tokens).write.mode("overwrite").json(f"{a.out}/token_audit")
    lengths = text.select(F.size(tokenize("_text", tuple(dict.fromkeys((*cfg.keep_tokens, *tags, *cfg.remove_tokens))))).alias("n_tokens"))
    length_profile(lengths, max_length=cfg.max_length).write.mode("overwrite").json(f"{a.out}/length_profile")


if __name__ == "__main__":
    main()
