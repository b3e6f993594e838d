"""Closest titles against brute force."""

import random

import pytest

from traceframe.operators import requirements as RQ


@pytest.mark.parametrize("on", [["project"], []])
def test_best_title(spark, on):
    rnd = random.Random(4)
    word = lambda n: "".join(chr(rnd.choice([rnd.randint(97, 122), rnd.randint(0x4E00, 0x4E40), 0x1F600])) for _ in range(n))
    projects = ["p", "q", "lone"] if on else ["p"]
    titles = [(p, i, word(rnd.randint(1, 30))) for p in projects[:2] for i in range(40)]
    values = [(p, word(rnd.randint(0, 12))) for p in projects for _ in range(60)] + [("p", "@@"), ("p", "")]
    t = spark.createDataFrame(titles, "project string, ord int, title string")
    v = spark.createDataFrame(values, "project string, section string")
    best = RQ.best_title(v, t, on, "section")
    got = {(r.project if on else "p", r.section): (r.score, r.matched_ord, r.matched_title) for r in best.collect()}
    want = {}
    for p, s in values:
        scored = [(len(set(s) & set(x)), -i, x) for q, i, x in titles if q == p]
        top = max(scored, default=(0, 0, ""))
        if top[0]:
            want[(p, s)] = (top[0], -top[1], top[2])
    assert got == want
    plan = RQ.best_title(v, t, on, "section")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 1  # only the salts, no characters


def test_titles_without_letters(spark):
    t = spark.createDataFrame([("p", 0, ""), ("p", 1, "？！")], "project string, ord int, title string")
    v = spark.createDataFrame([("p", "abc")], "project string, section string")
    assert RQ.best_title(v, t, ["project"], "section", chars="[a-z]").collect() == []
    assert [r.matched_title for r in RQ.best_outline_match(v, t, ["project"]).collect()] == ["abc"]
