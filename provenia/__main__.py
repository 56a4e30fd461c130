"""python -m provenia extract PAGES [--schema FILE] [--to FOLDER] [--parser MODULE:FUNCTION] [--tier1 MODULE:FUNCTION [--replies FOLDER --model NAME]]

The results as JSON; exit code 0, 1 if any instance is rejected, 2 if it can't run or a file can't be read. PAGES is a Parquet table of pages or, with --parser, a folder of
files. With --to each task writes its part of the results to the folder, which must be new, and a manifest names the parts; without, they are printed as one array.
--tier1 names a provider that is asked for what is missing; with --replies, a log of replies, each call is paid for once.
"""

import argparse
import io
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators.classify import classify_files
from provenia.operators.stages import shared_dir, staged
from provenia.operators.tier1 import with_paid_replies, with_provider
from provenia.plans.compiler import Tier1, contract, extract
from provenia.plans.schema import Schema, SchemaError, load, shipped
from provenia.sources.cache import ReplyLog
from provenia.sources.pages import named, pages_of_files
from provenia.sources.sink import exit_code, opened, save_results

#: Files that can't be read whose names are printed; all are counted.
FAULTS_SHOWN = 20


def read_pages(spark: SparkSession, told: argparse.Namespace) -> tuple[DataFrame, int]:
    """The pages, and the number of files that can't be read. With a parser files are read once, into a table, and one with a fault gives no pages; they go by their path."""
    if not told.parser:
        return spark.read.parquet(told.pages), 0
    read = staged(pages_of_files(spark, told.pages, told.parser).withColumn("file", F.col("path")), "pages")
    faults = read.filter("fault IS NOT NULL").select("file").distinct()
    for r in read.filter("fault IS NOT NULL").select("file", "fault").limit(FAULTS_SHOWN).collect():
        print(f"{r['file']}: {r['fault']}", file=sys.stderr)
    return read.join(faults, "file", "left_anti").drop("path", "fault"), faults.count()


def model_stage(told: argparse.Namespace) -> Tier1 | None:
    if not told.tier1:
        return None
    provider = named(told.tier1)
    return with_paid_replies(provider, ReplyLog(SparkSession.getActiveSession(), told.replies), told.model) if told.replies else with_provider(provider)


def results_of(pages: DataFrame, schemas: dict[str | None, Schema], classes: DataFrame | None, tier1: Tier1 | None = None) -> DataFrame:
    """file, instance_id, outcome, result of all instances, by the schema of their file's class; None stands for all files."""
    out = None
    for name, schema in schemas.items():
        own = pages if name is None else pages.join(classes.filter(F.col("schema") == name).select("file"), "file", "left_semi")
        found = extract(own, schema, tier1)
        told = contract(found, schema, "outcome")
        out = told if out is None else out.unionByName(told)
    return out


def printed(folder: str, manifest: dict) -> None:
    """The parts as one array, each copied as it is but for its brackets; one line is held at a time."""
    files, root = opened(folder)
    first = True
    for part in manifest["parts"]:
        with io.TextIOWrapper(files.open_input_stream(f"{root}/{part['name']}"), encoding="utf-8", newline="\n") as lines:
            next(lines)  # the opening bracket
            for line in lines:
                if line == "]\n":
                    break
                print(("[" if first else ",") + "\n" + line.rstrip("\n").removesuffix(","))
                first = False
    print("[]" if first else "]")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="provenia", description=__doc__)
    command = parser.add_subparsers(dest="command", required=True).add_parser("extract")
    command.add_argument("pages")
    command.add_argument("--schema")
    for name in ("--to", "--parser", "--tier1", "--replies", "--model"):
        command.add_argument(name)
    told = parser.parse_args(argv)
    if told.replies and not (told.tier1 and told.model):
        print("--replies needs --tier1 and --model", file=sys.stderr)
        return 2
    if "://" not in told.pages and not os.path.exists(told.pages):
        print(f"{told.pages}: not found", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("provenia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        tier1 = model_stage(told)
        if told.parser:
            named(told.parser)
    except (ImportError, AttributeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    pages, unread = read_pages(spark, told)
    if unread:
        print(f"files that can't be read: {unread}", file=sys.stderr)
    classes, failed = None, 2 if unread else 0
    try:
        if told.schema:
            schemas = {None: load(told.schema)}
        else:
            classes = classify_files(pages)
            used = {r["schema"]: r["fell_back"] for r in classes.groupBy("schema").agg({"fell_back": "max"}).toDF("schema", "fell_back").collect()}
            for name, fell in used.items():
                if fell:
                    print(f"warning: files of unknown type are read as {name}", file=sys.stderr)
            schemas = {n: shipped(n) for n in used}
    except SchemaError as e:
        print(e, file=sys.stderr)
        return 2
    if not schemas:
        print("[]")
        return failed
    results = results_of(pages, schemas, classes, tier1)
    if told.to:
        try:
            code = exit_code(save_results(results, told.to))
            return failed or code
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    folder = f"{shared_dir(spark)}/printed-{uuid.uuid4().hex}"
    # sorting reads its input twice, to find the ranges first: the results are a table by then, so that nothing is extracted or asked twice
    manifest = save_results(staged(results, "results").orderBy("file", "instance_id"), folder)
    printed(folder, manifest)
    return failed or exit_code(manifest)


if __name__ == "__main__":
    sys.exit(main())
