"""stats, show, split and export over a folder of metadata: python -m veridoc.cli stats ROOT"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import metrics as M, relational as L
from .plans.pipelines import chat_record
from .sources import files


def stats(meta: DataFrame) -> DataFrame:
    """One row: n, n_masks, by_type and by_language as maps."""
    entry = lambda c: M.counts(meta.where(F.col(c).isNotNull()), c).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))))
    return meta.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_mask").alias("n_masks")).select("*", entry("type").scalar().alias("by_type"), entry("language_code").scalar().alias("by_language"))


def show(meta: DataFrame, sample_id: str) -> DataFrame:
    return meta.where(F.col("sample_id") == sample_id).limit(1)


def split(meta: DataFrame, out: str, fraction: float, seed: int) -> None:
    files.write_split(L.stratified_split(meta, "sample_id", ["language_code", "type"], fraction=fraction, seed=seed), out)


def export(meta: DataFrame, out: str, prompt: str, style: str) -> int:
    rows = meta.select(F.col("sample_id").alias("id"), F.col("image_file").alias("image"), F.col("language_code").alias("language"), "type", "report_text", F.col("mask_file").alias("mask"))
    return files.write_chat(chat_record(rows.where(F.col("image").isNotNull()), prompt, style=style), out)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veridoc")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("stats", "show", "split", "export"):
        q = sub.add_parser(name)
        q.add_argument("root")
        if name == "show":
            q.add_argument("sample_id")
        if name in ("split", "export"):
            q.add_argument("out")
        if name == "split":
            q.add_argument("--fraction", type=float, default=0.1)
            q.add_argument("--seed", type=int, default=42)
        if name == "export":
            q.add_argument("--prompt", default="Examine the document image and write a forgery analysis report.")
            q.add_argument("--style", choices=("dataset", "submission"), default="dataset")
    a = p.parse_args(args)
    meta = files.load_metadata(SparkSession.builder.getOrCreate(), a.root)
    if a.what == "stats":
        stats(meta).show(truncate=False)
    elif a.what == "show":
        show(meta, a.sample_id).show(vertical=True, truncate=False)
    elif a.what == "split":
        split(meta, a.out, a.fraction, a.seed)
    else:
        print(export(meta, a.out, a.prompt, a.style))
    return 0


if __name__ == "__main__":
    sys.exit(main())
