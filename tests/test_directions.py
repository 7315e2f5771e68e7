"""Arrows and stretches of one direction in the JVM against the plain kernels."""

import random
import time

from pyspark.sql import functions as F

from paperloom.functions import directions
from paperloom.kernel import bidi, normalise

SIGNS = [*"אבגabz 1.,;(()[]{}\"$€«»'→← \t`\\\n-—🙂ⓐͅ", "```", "\n```\n", "\n\t~~~ x\n", "ה-R", "⁧", "א → b"]
FIXED = ["", "א", " ", "abc", "(א) b", "a (א", "```\n→א\n```\n→א", "א `→", "א \\→ →\\", "א $a→$ →", "שלום (Hello) עולם", "price $5 שלום", "« א » b"]


def texts(n):
    rnd = random.Random(n)
    return FIXED + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_arrows_and_segments_equal_the_kernels(spark):
    made = texts(1500)
    rows = spark.createDataFrame([*enumerate(made), (-1, None)], "i int, t string").repartition(4)
    both = [directions.segments(F.col("t"), F.lit(b), F.lit(f)).alias(f"s{b:d}{f:d}") for b in (True, False) for f in (True, False)]
    for r in rows.select("i", directions.normalised(F.col("t")).alias("n"), *both).collect():
        if r.i < 0:
            assert r.n is None and r.s00 == []
            continue
        assert r.n == normalise.normalised(made[r.i]), made[r.i]
        for b in (True, False):
            for f in (True, False):
                assert [tuple(s) for s in r[f"s{b:d}{f:d}"]] == bidi.segments(made[r.i], b, f), made[r.i]


def test_rows_join_to_the_text(spark):
    made = texts(300)
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(made)], "i int, t string, place string")
    found = directions.segment_rows(rows.repartition(3), "t").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.i, r.place)):
        by.setdefault(r.i, []).append((r.text, r.rtl))
    for i, t in enumerate(made):
        assert by.get(i, []) == bidi.segments(t, bidi.dominant_rtl(t), bidi.dominant_rtl(t))


def test_long_texts_end_in_seconds(spark):
    n = 50_000
    long = ["((" * n + "א" + "((( " * n + "b", "א b " * n, "`\\" * n + "א→", "→א`" * n, "a\n```\nא→\n" * n, "א" + " " * 4 * n + "x"]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(long)), "i int, t string").repartition(4)
    found = {r.i: (r.n, r.s) for r in rows.select("i", F.length(directions.normalised(F.col("t"))).alias("n"), F.size(directions.segments(F.col("t"), F.lit(True), F.lit(True))).alias("s")).collect()}
    assert all(found[i][0] == len(t) for i, t in enumerate(long)) and found[1][1] == 2 * n and time.time() - began < 60
