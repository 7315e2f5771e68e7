"""Commands over single files: python -m paperloom.commands doctor | preflight | build |
verify-run | review | validate. Each prints a JSON report; 0 is returned where it is valid.

Files are read and checked through the same operators that serve tables."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import features
from paperloom.operators import documents
from paperloom.sources.files import markdown_files

SCHEMA_VERSION = 1


def _one(frame: DataFrame, drop: tuple[str, ...] = ()) -> dict:
    row = frame.first()
    return {k: v for k, v in row.asDict(True).items() if k not in drop}


def _source(spark: SparkSession, path: str) -> DataFrame:
    """text of one Markdown file; what is not UTF-8 is an error."""
    found = markdown_files(spark, path).first()
    if found is None or not found.valid:
        raise ValueError(f"cannot read UTF-8 Markdown: {path}")
    return spark.createDataFrame([(found.text,)], "text string")


def doctor(spark: SparkSession) -> dict:
    return _one(documents.doctor(spark))


def preflight(spark: SparkSession, path: str, source: str = "llm") -> dict:
    return _one(features.preflight(_source(spark, path), source=F.lit(source)), ("text",))


def build(spark: SparkSession, path: str, output: str, source: str = "llm", expected: str | None = None) -> tuple[dict, str]:
    """The report and the extracted text. The package is written only if it passes all
    checks; a file that is there from before goes otherwise."""
    row = documents.built(_source(spark, path), source=F.lit(source), expected=F.lit(expected)).first().asDict(True)
    data = row.pop("docx")
    if data is None:
        if os.path.exists(output):
            os.remove(output)
    else:
        os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
        with open(output, "wb") as f:
            f.write(data)
    return _shown(row)


def verify(spark: SparkSession, path: str, document: str, source: str = "llm", expected: str | None = None) -> tuple[dict, str]:
    packages = spark.read.format("binaryFile").load(document).select(F.col("content").alias("docx"))
    both = _source(spark, path).crossJoin(packages.limit(1))  # one row each
    return _shown(documents.verified(both, source=F.lit(source), expected=F.lit(expected)).drop("docx").first().asDict(True))


def validate(spark: SparkSession, document: str) -> dict:
    found = documents.package_report(spark.read.format("binaryFile").load(document).select(F.col("content").alias("docx")).limit(1)).first()
    return found.package.asDict(True)


def _shown(row: dict) -> tuple[dict, str]:
    row.pop("text", None)
    meaning = row.get("semantics")
    return row, (meaning or {}).pop("text", None) or ""


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="compile a fixed document twice and check it")
    for name, files in (("preflight", ["input"]), ("build", ["input", "output"]), ("verify-run", ["input", "document"]), ("review", ["input", "document"]), ("validate", ["document"])):
        sub = commands.add_parser(name)
        for f in files:
            sub.add_argument(f)
        if name != "validate":
            sub.add_argument("--source", default="llm")
        if len(files) == 2:
            for option in ("--report", "--expected-input-sha256", "--review-text"):
                sub.add_argument(option)
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    text = ""
    try:
        if given.command == "doctor":
            found = doctor(spark)
        elif given.command == "preflight":
            found = preflight(spark, given.input, given.source)
        elif given.command == "validate":
            found = validate(spark, given.document)
        elif given.command == "build":
            found, text = build(spark, given.input, given.output, given.source, given.expected_input_sha256)
        else:
            found, text = verify(spark, given.input, given.document, given.source, given.expected_input_sha256)
    except Exception as e:
        print(json.dumps({"valid": False, "errors": [str(e)]}), file=sys.stderr)
        return 1
    report = {"schema_version": SCHEMA_VERSION, "command": given.command} | found
    said = json.dumps(report, ensure_ascii=True, indent=2, default=str)
    for path, content in ((getattr(given, "report", None), said), (getattr(given, "review_text", None), text)):
        if path:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(content)
    print(said)
    return 0 if found["valid"] else 1


if __name__ == "__main__":
    sys.exit(main())
