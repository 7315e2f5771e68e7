"""Manifests, receipts and file sets: gates over tables of small records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import terms_in

RECEIPT = "docx_sha256 string, pdf_sha256 string, pages_expected int, pages_rendered int, pages_reviewed int, reviewed_pages array<int>, issues array<string>, images int"


def errors_of(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that do not hold (null counts as not)."""
    said = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks])
    return F.filter(said, lambda m: m.isNotNull())


def visual_gate(receipts: DataFrame) -> DataFrame:
    """receipts (with actual_docx_sha256, actual_pdf_sha256) with errors and visual_valid:
    every page was rendered and reviewed, nothing is open and both files are the ones seen."""
    n = F.col("pages_expected")
    wanted = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    errors = errors_of(
        (n >= 1, "pages_expected must be at least 1"),
        (F.col("pages_rendered") == n, "not all pages were rendered"),
        (F.col("pages_reviewed") == n, "not all pages were reviewed"),
        (F.col("images") == n, "images and pages differ in number"),
        (F.col("reviewed_pages") == wanted, "reviewed pages are not 1 to n"),
        (F.size("issues") == 0, "issues are open"),
        (F.col("docx_sha256") == F.col("actual_docx_sha256"), "the document has changed"),
        (F.col("pdf_sha256") == F.col("actual_pdf_sha256"), "the PDF has changed"),
    )
    return receipts.withColumn("errors", errors).withColumn("visual_valid", F.size("errors") == 0)


def golden_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name and state (same, changed, missing, unexpected) of images by bytes and hash."""
    e, a = expected.select("name", F.struct("bytes", "sha256").alias("e")), actual.select("name", F.struct("bytes", "sha256").alias("a"))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") == F.col("e"), "same").otherwise("changed")
    return e.join(a, "name", "full_outer").select("name", state.alias("state"))


def runtime_manifest(manifests: DataFrame, body: str = "value", engine: str = "paperloom") -> DataFrame:
    """manifests with schema_version, engine, binaries, errors and valid of their JSON."""
    got = F.from_json(F.col(body), "schema_version int, engine string, binaries map<string,string>")
    errors = errors_of((got["schema_version"] == 1, "schema_version must be 1"), (got["engine"] == engine, "unknown engine"), (got["binaries"].isNotNull(), "binaries are missing"))
    return manifests.select("*", got["schema_version"].alias("schema_version"), got["engine"].alias("engine"), got["binaries"].alias("binaries"), errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


def unlisted_binaries(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that the manifest (binaries) does not list with that hash."""
    listed = manifest.select(F.explode("binaries").alias("path", "sha256"))
    return files.join(listed, ["path", "sha256"], "left_anti")


def set_check(required: Column, names: Column) -> Column:
    """missing and unexpected names of two arrays, sorted."""
    return F.struct(F.sort_array(F.array_except(required, names)).alias("missing"), F.sort_array(F.array_except(names, required)).alias("unexpected"))


def banned_terms(files: DataFrame, terms: list[str]) -> DataFrame:
    """path and term of every banned term that a file holds."""
    return files.select("path", F.explode(terms_in(F.col("text"), terms)).alias("term"))
