"""Isolate marks against a plain stack, answers of unknown shape against plain JSON."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from paperloom.operators import chat, isolates

O, C = "⁦", "⁩"


def plain(text):
    stack, pairs, stray, faults, nested = [], 0, 0, [], 0
    for i, c in enumerate(text or ""):
        if c == O:
            if stack:
                nested += 1
                faults.append(i)
            stack.append(i)
        elif c == C:
            if stack:
                stack.pop()
                pairs += 1
            else:
                stray += 1
                faults.append(i)
    faults += stack
    return pairs, nested, stray, len(stack), min(faults, default=None), not faults


def test_balance_equals_a_stack(spark):
    rnd = random.Random(2)
    texts = [None, "", "abc", O + "a" + C, C, O, O + O + C + C, C + O + C, "🙂" + O + "é" + C + C, *["".join(rnd.choice([O, C, C, "a", "🙂"]) for _ in range(rnd.randrange(25))) for _ in range(300)]]
    rows = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:5])], "doc_id int, text string").withColumn("pairs", F.lit("clash")).repartition(3)
    got = Counter(tuple(r) for r in isolates.isolate_balance(rows).collect())
    assert got == Counter((i, *plain(t)) for i, t in enumerate(texts))


def test_balance_of_long_texts(spark):
    n = 50_000
    rows = spark.createDataFrame([(1, O * n + C * n), (2, C * n + O * n), (3, ("x" + O + "y" + C) * n)], "doc_id int, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in isolates.isolate_balance(rows).collect()}
    assert got == {1: (n, n - 1, 0, 0, 1, False), 2: (0, n - 1, n, n, 0, False), 3: (n, 0, 0, 0, None, True)}


def test_answers_of_unknown_shape(spark):
    cases = [
        ({"output_text": "a", "content": "no"}, "a"), ({"output_text": 5, "text": "b"}, "b"), ({"output": [{"content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "no"}]}, {"content": "odd"}, 7]}, "a"),
        ({"content": [{"type": "text", "text": "a"}, "b", {"type": "tool"}, 3]}, "a\nb"), ({"content": {"odd": 1}, "response": "r"}, "r"), ({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}, "ab"), ({"candidates": []}, ""),
        ({"choices": [{"message": {"content": "m"}}]}, "m"), ({"choices": [{"delta": {"content": "d"}}]}, "d"), ({"message": {"content": ["x", {"text": "y"}]}}, "x\ny"), ([1, 2], ""), ("plain", ""), (None, ""),
    ]
    bodies = [json.dumps(c) for c, _ in cases] + ["{no", "", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", chat.answer_of(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == [w for _, w in cases] + [None, None, None]


def test_shapes(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (1, '{"a": 2.5, "b": [1]}'), (1, "{no"), (2, None)], "k int, b string")
    got = {r.k: (r.n, r.shape) for r in chat.shapes(rows, "b", "k").collect()}
    assert got[1] == (3, "OBJECT<a: DECIMAL(21,1), b: ARRAY<BIGINT>>") and got[2][0] == 1
