"""Blocks of texts against a plain pass over their lines."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.operators import skeleton


def plain(text):
    lines = (text or "").splitlines()
    out, fence, inside = [], None, set()
    for n, x in enumerate(lines):
        m = re.match(r"[ \t]*(`{3,}|~{3,})", x)
        if fence:
            inside.add(n)
            if m and m[1][0] == fence[1][0] and min(len(m[1]), 16) >= min(len(fence[1]), 16):
                out.append(("fence", fence[0], n, 1))
                fence = None
        elif m:
            inside.add(n)
            fence = (n, m[1])
    if fence:
        out.append(("fence", fence[0], len(lines) - 1, 1))
    free = {n: x for n, x in enumerate(lines) if n not in inside}
    item = {n: min(32, 1 + len(re.match(r"[ \t]*", x)[0].replace("\t", "    ")) // 2) for n, x in free.items() if re.match(skeleton.ITEM, x)}
    quote = {n: min(32, re.match(r"[ \t]*>[ \t>]*", x)[0].count(">")) for n, x in free.items() if re.match(r"[ \t]*>", x)}
    for n, x in free.items():
        if m := re.match(r" {0,3}(#{1,6})[ \t]+[^ \t]", x):
            out.append(("heading", n, n, len(m[1])))
        if re.fullmatch(r"[ \t]*(=+|-{3,})[ \t]*", x) and n and lines[n - 1].strip(" \t") and not re.match(r"[ \t]*(`{3}|~{3})", lines[n - 1]):
            out.append(("heading", n - 1, n, 1 if "=" in x else 2))
    for d in range(1, 33):
        now = None
        for n in [*range(len(lines)), None]:  # quotes: neighbours only
            if n is not None and quote.get(n, 0) >= d:
                now = [now[0] if now else n, n]
            elif now:
                out.append(("quote", *now, d))
                now = None
        now = None
        for n in [*range(len(lines)), None]:  # lists: blank and indented lines do not end them
            if n is not None and item.get(n, 0) >= d:
                now = [now[0] if now else n, n]
            elif now and (n is None or n not in free or n in item or (lines[n].strip(" \t") and len(re.match(r"[ \t]*", lines[n])[0].replace("\t", "    ")) < 2)):
                out.append(("list", *now, d))
                now = None
    n = 0
    while n < len(lines):
        if n in free and "|" in lines[n]:
            hi = n
            while hi + 1 in free and "|" in lines[hi + 1]:
                hi += 1
            rules = [r for r in range(n + 1, hi + 1) if re.match(skeleton.RULE, lines[r])]
            if rules:
                out.append(("table", rules[0] - 1, hi, 1))
            n = hi
        n += 1
    return Counter(out)


FIXED = [None, "", "# a\n\nb\n===\n\n- x\n  - y\n\n  more\n- z\nend", "```\n# no\n~~~\n```\n> q\n> > r\n\n| a | b |\n|---|---|\n| 1 |\n\n```x", "\n\n", "~~~~\n~~~\n~~~~~\n---", "- a\n\tb\n\t\t- c\n1. d\n```\n```\n2) e"]


def test_blocks_equal_a_plain_pass(spark):
    rnd = random.Random(4)
    made = ["- ", "  - ", "\t* ", "1. ", "> ", ">> ", "# ", "### ", "```", "~~~~", "===", "---", "| a | b |", "|---|---|", "--- | ---", "x", "  y", "", " ", "\x0b"]
    texts = FIXED + ["\n".join(rnd.choice(made) + rnd.choice(["a", "", "b c"]) for _ in range(rnd.randrange(40))) for _ in range(250)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, kind string").repartition(4)
    for stretch in (512, 3):
        found = skeleton.blocks(rows.unionByName(rows.limit(5)), stretch=stretch).collect()
        by = {}
        for r in found:
            by.setdefault(r.doc_id, Counter())[(r.kind, r.first_line, r.last_line, r.depth)] += 1
        for i, t in enumerate(texts):
            assert by.get(i, Counter()) == plain(t), (stretch, t)


def test_long_texts_are_split(spark):
    text = "\n".join(["- a", "```", "# no", "```", "# yes", "> q", ""] * 20_000)
    found = skeleton.blocks(spark.createDataFrame([(1, text), (None, None)], "doc_id int, text string")).groupBy("kind").agg(F.count("*").alias("n"), F.max("last_line").alias("last")).collect()
    assert {r.kind: (r.n, r.last) for r in found} == {"list": (20_000, 139_993), "fence": (20_000, 139_996), "heading": (20_000, 139_997), "quote": (20_000, 139_998)}


def test_only_marked_lines_are_folded(spark, monkeypatch):
    """Prose is not looked at by all patterns, groups of runs are hashed, and texts that are
    spread over tasks give the same."""
    assert "ObjectHashAggregate" not in skeleton.blocks(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    kinds = [spark.range(1).select(skeleton._code(F.lit(x))).first()[0] for x in ("a", " a", "  a", "\ta", "", " \t", "1. a", "  > a", "a | b", "\t`")]
    assert kinds == [1, 1, 0, 0, 0, 0, 2, 2, 2, 2]
    texts = ["- a\nb\n- c\n\n  d\n\n- e\n```\n\n|\n```\n|---|---|\nx|y\n---|---\n---|---\n"] + ["- a\nb c d\n  e\n> q\n" * 5] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for signs in (1 << 16, 0):
        monkeypatch.setattr(skeleton, "SPREAD", signs)
        for stretch in (512, 2):
            found = skeleton.blocks(rows, stretch=stretch).collect()
            for i, t in enumerate(texts):
                assert Counter((r.kind, r.first_line, r.last_line, r.depth) for r in found if r.doc_id == i) == plain(t), (signs, stretch, t)
