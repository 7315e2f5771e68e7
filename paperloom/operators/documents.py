"""Parsing, compiling and checking documents, one pass over each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.functions import dialect

NODE = "node_id int, parent_id int, place int, depth int, kind string, literal string, attrs map<string,string>"
CHECK = "valid boolean, errors array<string>"
FEATURES = (
    "bytes bigint, lines bigint, headings bigint, heading_levels array<int>, tables bigint, list_items bigint, fenced_code_blocks bigint, math_expressions bigint, block_math bigint, links bigint, "
    "blockquotes bigint, thematic_breaks bigint, bold bigint, strikethrough bigint, inline_code bigint, contains_rtl boolean, contains_ltr boolean, contains_em_dash boolean, bidi_controls bigint, syntax_errors array<string>"
)
STATS = "paragraphs bigint, headings bigint, empty_headings bigint, rtl_paragraphs bigint, mixed_paragraphs bigint, tables bigint, table_cells bigint, centered_table_cells bigint, equations bigint, characters bigint"
ACTUAL = "headings bigint, tables bigint, list_items bigint, math_expressions bigint, rtl_paragraphs bigint, rtl_runs bigint, ltr_runs bigint, rtl_tables bigint, code_fonts bigint, links bigint, bold_runs bigint, strike_runs bigint"
PACKAGE = "required_parts boolean, xml_parts bigint, em_dash_parts bigint, unsafe_control_parts bigint, isolate_parts bigint, isolate_pairs bigint, overrides bigint, engine_verified boolean"
GATES = "engine string, engine_verified boolean, runtime_manifest_verified boolean, markdown_preflight boolean, core_self_test boolean, feature_coverage boolean, ooxml_semantics boolean, text_fidelity boolean, deterministic_replay boolean, input_sha256_verified boolean"
SELF_TEST = f"{CHECK}, engine string, deterministic boolean, first_sha256 string, second_sha256 string"
REPORT = (
    f"valid boolean, errors array<string>, input_sha256 string, input_bytes bigint, output_sha256 string, checks struct<{GATES}>, features struct<{FEATURES}>, package struct<{CHECK}, checks: struct<{PACKAGE}>>, "
    f"semantics struct<{CHECK}, text: string, text_sha256: string, stats: struct<{STATS}>>, fidelity struct<{CHECK}, expected_tokens: bigint, missing_tokens: bigint, token_coverage: double, missing_sample: map<string,bigint>>, "
    f"coverage struct<{CHECK}, actual: struct<{ACTUAL}>>, replay boolean"
)


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Rows that are worked on together; results of equal inputs kept in a task, and the signs of
#: such inputs; signs after which rings of objects are cleared away.
SLICE, SAME, SHORT, CLEARED = 200, 256, 4096, 1 << 21


def _size(values: tuple) -> int:
    return sum(len(v) for v in values if isinstance(v, (str, bytes)))


def _passed(docs: DataFrame, kept: list[str], inputs: list, new: T.StructType, work, batch_of) -> DataFrame:
    """The kept columns of docs and those of new, in one pass: batch_of(columns, found) makes
    a batch of the kept columns of some rows and of work(*values) for each. Rows are cut into
    small batches, since one document may be large. Short inputs that are equal are worked on
    once. Documents become many small objects, which the collector would look through again
    and again, so it runs between batches only."""
    source = docs.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *new.fields])
    n, m, names = len(kept), len(inputs), schema.names
    slice_, same, short, cleared = SLICE, SAME, SHORT, CLEARED

    def run(batches):
        import gc

        seen, read, on = {}, 0, gc.isenabled()

        def worked(values):
            nonlocal read
            size = _size(values)
            read += size
            if size > short or not all(v is None or isinstance(v, (str, bytes, bool, int)) for v in values):
                return work(*values)
            if values not in seen:
                if len(seen) >= same:
                    seen.clear()
                seen[values] = work(*values)
            return seen[values]

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, slice_):
                    gc.disable()
                    part, found = batch.slice(at, slice_), []
                    for values in zip(*(part.column(n + i).to_pylist() for i in range(m)), strict=True):
                        found.append(worked(values))
                        if read > cleared:
                            read = gc.collect() * 0
                    made = batch_of(part.columns[:n], found)
                    del found
                    if on:
                        gc.enable()
                    yield pa.RecordBatch.from_arrays(made, names=names)
        finally:
            if on:
                gc.enable()

    return source.mapInArrow(run, schema)


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def _mapped(docs: DataFrame, inputs: list, ddl: str, work, only: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of ddl (those of only, where it is given: what nobody reads need
    not leave Python), computed by work(*values) for each row; other columns stay (those of
    keep, where it is given: what nobody reads need not pass through Python either), those
    with the names of results are replaced. A row that work() fails on has null results and the
    failure in `kernel_error`, null elsewhere: one document never ends a job."""
    whole = _struct(ddl + ", kernel_error string")
    new = T.StructType([f for f in whole.fields if only is None or f.name in [*only, "kernel_error"]])
    places, arrow = [whole.names.index(name) for name in new.names], [to_arrow_schema(new).field(name).type for name in new.names]

    def guarded(*values):
        try:
            found = (*work(*values), None)
        except Exception as e:  # the last line: kernels are made not to fail
            found = (*[None] * (len(whole) - 1), _reason(e))
        return tuple(found[i] for i in places)

    def batch_of(columns, found):
        return [*columns, *(pa.array([r[i] for r in found], t) for i, t in enumerate(arrow))]

    return _passed(docs, [c for c in (docs.columns if keep is None else keep) if c not in new.names], inputs, new, guarded, batch_of)


def _inputs(text: str, source, profile) -> list:
    hint = source if source is not None else F.lit("auto")
    chosen = dialect.effective_profile(profile if profile is not None else F.lit("auto"), hint)
    return [F.coalesce(F.col(text), F.lit("")), dialect.extended(chosen)]


def compiled(docs: DataFrame, text: str = "text", source=None, profile=None, rtl_font: str = "Arial", base_font: str = "Arial", only: list[str] | None = None) -> DataFrame:
    """docs with `docx` (bytes of a Word package) and `docx_sha256`; only: which columns are
    wanted, of these and docx_bytes (the length)."""
    import hashlib

    from paperloom.kernel.docx import compile_docx

    def work(markdown, extended):
        data = compile_docx(markdown, extended, rtl_font, base_font)
        return data, hashlib.sha256(data).hexdigest(), len(data)

    return _mapped(docs, _inputs(text, source, profile), "docx binary, docx_sha256 string, docx_bytes int", work, only or ["docx", "docx_sha256"])


def rich(docs: DataFrame, text: str = "text", source=None, profile=None, only: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with `rich_html`, a fragment to paste; only: which columns are wanted, of this,
    html_sha256 and html_length; keep: the columns of docs that are."""
    import hashlib

    from paperloom.kernel.richhtml import rich_html

    def work(markdown, extended):
        page = rich_html(markdown, extended)
        return page, hashlib.sha256(page.encode()).hexdigest(), len(page)

    return _mapped(docs, _inputs(text, source, profile), "rich_html string, html_sha256 string, html_length int", work, only or ["rich_html"], keep)


def nodes(docs: DataFrame, text: str = "text", source=None, profile=None, only: list[str] | None = None) -> DataFrame:
    """A row for each node of each document's tree, with the other columns of docs. only:
    the columns of nodes that are wanted. Rows leave Python as columns, ready to be read. A
    document that no tree can be made of has one row, without a node but with the reason in
    `kernel_error`, which is null elsewhere."""
    from paperloom.kernel.markdown import parse
    from paperloom.kernel.normalise import normalised
    from paperloom.kernel.tree import flat

    whole = _struct(NODE)
    nodes_ = T.StructType([f for f in whole.fields if only is None or f.name in only])
    new = T.StructType([*nodes_.fields, *_struct("kernel_error string").fields])
    wanted = [(whole.names.index(f.name), to_arrow_schema(nodes_).field(f.name).type) for f in nodes_.fields]
    full = "attrs" in new.names

    def work(markdown, extended):
        try:
            rows, error = flat(parse(normalised(markdown), extended), full), None
        except Exception as e:  # the last line: kernels are made not to fail
            rows, error = [(None,) * len(whole)], _reason(e)
        return len(rows), [[r[j] for r in rows] for j, _ in wanted], error

    def batch_of(columns, found):
        rows = pa.array([i for i, (n, *_) in enumerate(found) for _ in range(n)], pa.int32())
        own = (pa.array([v for _, values, _ in found for v in values[k]], t) for k, (_, t) in enumerate(wanted))
        return [*(c.take(rows) for c in columns), *own, pa.array([e for *_, e in found], pa.string()).take(rows)]

    kept = [c for c in docs.columns if c != text and c not in (*whole.names, "kernel_error")]
    return _passed(docs, kept, _inputs(text, source, profile), new, work, batch_of)


def segments(rows: DataFrame, text: str, base_rtl: bool, fallback_rtl: bool) -> DataFrame:
    """rows with `segments`: stretches of one direction."""
    from paperloom.kernel.bidi import segments as cut

    return _mapped(rows, [F.coalesce(F.col(text), F.lit(""))], "segments array<struct<text:string,rtl:boolean>>", lambda t: ([{"text": s, "rtl": r} for s, r in cut(t, base_rtl, fallback_rtl)],))


def mirrored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `normalised`: all steps before parsing, arrows included."""
    from paperloom.kernel.normalise import normalised

    return _mapped(docs, [F.coalesce(F.col(text), F.lit(""))], "normalised string", lambda t: (normalised(t),))


def formulas(rows: DataFrame, latex: str, display: bool = False) -> DataFrame:
    """rows with `tokens`, `omml` and `mathml` of a LaTeX column."""
    from paperloom.kernel import latex as kernel

    def work(value):
        return [{"type": t, "value": v} for t, v in kernel.tokens(value)], kernel.to_omml(value, display), kernel.to_mathml(value, display)

    return _mapped(rows, [F.coalesce(F.col(latex), F.lit(""))], "tokens array<struct<type:string,value:string>>, omml string, mathml string", work)


def _package(docx: str, text: str | None, source, profile) -> tuple[list, object]:
    """(inputs, what makes the bytes of a package of their values): those of a column, or
    those that a column of texts compiles to. Packages are several times as large as their
    texts, so they are best used up where they are made; one that fails counts as missing."""
    from paperloom.kernel.docx import compile_docx

    def made(markdown, extended):
        try:
            return compile_docx(markdown, extended)
        except Exception:
            return b""

    return ([F.col(docx)], lambda data: data or b"") if text is None else (_inputs(text, source, profile), made)


def parts(packages: DataFrame, docx: str = "docx", text: str | None = None, source=None, profile=None) -> DataFrame:
    """packages with `names` (in order) and `parts` (map of name to bytes) of a ZIP column,
    or of the packages that the texts of a column compile to."""
    from paperloom.kernel.review import read_package

    inputs, opened = _package(docx, text, source, profile)

    def work(*values):
        names, found, errors = read_package(opened(*values))
        return names, list(found.items()), errors

    return _mapped(packages, inputs, "names array<string>, parts map<string,binary>, zip_errors array<string>", work)


def package_report(packages: DataFrame, docx: str = "docx", text: str | None = None, source=None, profile=None) -> DataFrame:
    """packages with `package` and `semantics`: the checks of a Word package by itself. With
    text, the packages are those that its texts compile to, checked where they are made."""
    from paperloom.kernel.review import Package, semantics, validate

    inputs, given = _package(docx, text, source, profile)

    def work(*values):
        opened = Package(given(*values))
        v, s = validate(opened), semantics(opened)
        return {k: v[k] for k in ("valid", "errors", "checks")}, s

    schema = f"package struct<{CHECK}, checks: struct<{PACKAGE}>>, semantics struct<{CHECK}, text: string, text_sha256: string, stats: struct<{STATS}>>"
    return _mapped(packages, inputs, schema, work)


def doctor(spark: SparkSession) -> DataFrame:
    """One row: whether the compiler passes its self-test on an executor."""
    from paperloom.kernel.docx import compile_docx
    from paperloom.kernel.review import self_test

    def work(_):
        found = self_test(compile_docx)
        return tuple(found[k] for k in ("valid", "errors", "engine", "deterministic", "first_sha256", "second_sha256"))

    return _mapped(spark.range(1), [F.col("id")], SELF_TEST, work).drop("id")


def report_of(markdown: str, data: bytes | None, source: str, compiled: bytes | None, tested: dict, expected: str | None, before: dict | None = None) -> tuple:
    """All gates of a package against its source. What compares the two is only looked at
    where the source passes preflight and the package is sound. before: its preflight, where
    that was made."""
    import hashlib

    from paperloom.kernel import review

    found = review.all_checks(markdown, data or b"", source, compiled, before)
    before, package = found["preflight"], found["package"]
    same = expected is None or before["sha256"] == expected.lower()
    errors = [*before["errors"], *tested["errors"], *package["errors"], *[f"the input is not the expected one: {before['sha256']}"] * (not same)]
    errors += [e for name in ("coverage", "semantics", "fidelity", "replay") if found[name] for e in found[name]["errors"]]
    holds = lambda name: bool(found[name] and found[name]["valid"])
    ours = package["checks"]["engine_verified"]
    checks = dict(zip(review.CHECKS, (review.ENGINE if ours else None, ours, tested["valid"], before["valid"], tested["valid"], *map(holds, ("coverage", "semantics", "fidelity", "replay")), same), strict=True))
    fidelity = found["fidelity"] and found["fidelity"] | {"missing_sample": list(found["fidelity"]["missing_sample"].items())}
    return (
        not errors, errors, before["sha256"], before["features"]["bytes"], None if data is None else package["sha256"], checks, before["features"],
        {k: package[k] for k in ("valid", "errors", "checks")}, found["semantics"], fidelity, found["coverage"], found["replay"] and found["replay"]["valid"],
    )


def _tested():
    """The self-test of the compiler, made once in a task."""
    from paperloom.kernel.docx import compile_docx
    from paperloom.kernel.review import self_test

    kept: list[dict] = []

    def test():
        if not kept:
            kept.append(self_test(compile_docx))
        return kept[0]

    return test


def verified(docs: DataFrame, text: str = "text", docx: str = "docx", source=None, profile=None, expected=None, of: str | None = None, only: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (with sources and packages) with all checks, `valid` and `errors`. expected: a
    column with the SHA-256 that the source should have, null where any will do. of: a column
    of texts; the packages are those that it compiles to, checked where they are made. only:
    the columns of results that are wanted; keep: the columns of docs that are."""
    from paperloom.kernel.docx import compile_docx

    hint = source if source is not None else F.lit("llm")
    text_, extended = _inputs(text, hint, profile)
    given = [F.col(docx)] if of is None else _inputs(of, source, profile)
    test = _tested()

    def work(markdown, s, wide, wanted, *given):
        data = given[0] or b"" if of is None else compile_docx(*given)
        return report_of(markdown, data, s, compile_docx(markdown, wide), test(), wanted)

    return _mapped(docs, [text_, hint, extended, expected if expected is not None else F.lit(None).cast("string"), *given], REPORT, work, only, keep)


def built(docs: DataFrame, text: str = "text", source=None, profile=None, expected=None, only: list[str] | None = None) -> DataFrame:
    """Compiles and checks in one pass: docs with `docx` and all checks. Sources that fail
    preflight, or are not the expected ones, are not compiled; a package that fails a check
    is not handed out either: its docx is null. only: the columns of results that are wanted."""
    from paperloom.kernel import review
    from paperloom.kernel.docx import compile_docx

    hint = source if source is not None else F.lit("llm")
    text_, extended = _inputs(text, hint, profile)
    test, gates = _tested(), review.CHECKS

    def work(markdown, s, wide, wanted):
        before, tested = review.preflight(markdown, s), test()
        same = wanted is None or before["sha256"] == wanted.lower()
        errors = [*before["errors"], *tested["errors"], *[f"the input is not the expected one: {before['sha256']}"] * (not same)]
        if errors:
            checks = dict.fromkeys(gates, False) | {"engine": None, "runtime_manifest_verified": tested["valid"], "markdown_preflight": before["valid"], "core_self_test": tested["valid"], "input_sha256_verified": same}
            return None, False, errors, before["sha256"], before["features"]["bytes"], None, checks, before["features"], None, None, None, None, None
        data = compile_docx(markdown, wide)
        report = report_of(markdown, data, s, compile_docx(markdown, wide), tested, wanted, before)
        return data if report[0] else None, *report

    return _mapped(docs, [text_, hint, extended, expected if expected is not None else F.lit(None).cast("string")], "docx binary, " + REPORT, work, only)


def split_valid(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, all others). Cache or write the input first: both read it."""
    good = F.coalesce(F.col("valid"), F.lit(False))
    return reports.filter(good), reports.filter(~good)
