"""References resolved against brute force: hashed ids, one dominating document, table names and nearest pages."""

import random

from pyspark.sql import functions as F

from traceframe.operators import facts as FA, keyed as K, requirements as RQ

def exchanges(df):
    """Shuffles in the plan, where one or two are planned twice and run once."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


REQS = "project string, doc_id long, category string, req_no int, id string, source_page int, source_context string"
LINKS = "project string, doc_id long, category string, n int, target_page int, target_table string"


def doc_of(rnd):
    return rnd.choice([1 << 40, 1 << 40, 1 << 40, -rnd.getrandbits(60) % 997 - (1 << 50)])  # a third or more in one document, sparse ids


def test_requirement_links(spark):
    rnd = random.Random(2)
    reqs = [("p", doc_of(rnd), rnd.choice("ab"), i, f"R{i}", rnd.choice([None, 1, 2, 3, 9]), rnd.choice(["", "见附表 1", "附表12 和附表二", "文字"])) for i in range(400)]
    reqs += [("p", 77, "a", 900, "R900", 5, "")]
    links = [("p", doc_of(rnd), rnd.choice("ab"), i, rnd.choice([None, 1, 2, 7]), rnd.choice(["", "附表1", "附表2", "附表"])) for i in range(300)]
    links += [("p", 77, "a", 900, 4, "附表9"), ("p", 77, "a", 901, None, ""), links[0], ("p", 5, "a", 902, 1, "")]
    df = RQ.resolve_requirement_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(reqs, REQS))
    got = sorted((r.n, r.status, tuple(r.resolved_ids), tuple(r.resolved_pages)) for r in df.collect())
    want = []
    for p, d, c, n, page, table in links:
        pool = [r for r in reqs if r[:3] == (p, d, c)]
        on_page = [r for r in pool if page is not None and r[5] == page]
        inside = on_page or pool
        with_table = [r for r in inside if table and table in r[6].replace(" ", "")]
        hits = with_table or (on_page if on_page else pool if len(pool) == 1 else [])
        want.append((n, "resolved" if hits else "unresolved", tuple(r[4] for r in hits), tuple(sorted({r[5] for r in hits if r[5]}))))
    assert got == sorted(want)
    assert exchanges(RQ.resolve_requirement_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(reqs, REQS))) <= 7


FACTS = "project string, doc_id long, key string, block_ord int, pattern_ord int, match_ord int, value string, norm string, source_page int, source_block_excerpt string"


def test_fact_links(spark):
    rnd = random.Random(3)
    facts = [("p", doc_of(rnd), rnd.choice("kl"), i, 0, 0, f"v{i % 3}", f"n{0 if i % 7 else 1}", rnd.choice([None, 1, 3, 8, 20, 700]), rnd.choice(["", "附表 1", "附表2"])) for i in range(200)]
    facts += [("p", 50 + d, "k", i, 0, 0, f"x{i}", "same", page, ctx) for d in range(30) for i, (page, ctx) in enumerate(
        [(rnd.choice([2, 5]), ""), (rnd.randint(1, 9), "附表1"), (rnd.choice([300, 600]), "附表 1")])]
    links = [("p", rnd.choice([doc_of(rnd), 50 + rnd.randrange(31)]), rnd.choice("kkl"), i, rnd.choice([None, 1, 3, 5, 290, 450, 900]), rnd.choice(["", "附表1", "附表3"])) for i in range(400)]
    schema = "project string, doc_id long, fact_key string, n int, target_page int, target_table string"
    for chunk in (2, 256):
        df = FA.resolve_fact_links(spark.createDataFrame(links, schema), spark.createDataFrame(facts, FACTS), chunk)
        got = sorted((r.n, r.status, r.resolved_value, r.resolved_page or -1) for r in df.collect())
        want = []
        for p, d, k, n, page, table in links:
            pool = [f for f in facts if f[:3] == (p, d, k)]
            named = lambda fs: [f for f in fs if table and table in f[9].replace(" ", "")]
            on_page = [f for f in pool if page is not None and f[8] == page]
            inside = on_page or pool
            hits = named(inside) or inside
            agreed = hits and len({f[7] for f in hits}) == 1
            best = min(hits, key=lambda f: (abs((f[8] or 0) - (page or 0)), f[3])) if agreed else None
            want.append((n, "resolved" if best else "unresolved", best[6] if best else "", (best[8] or -1) if best else -1))
        assert got == sorted(want)
    assert exchanges(FA.resolve_fact_links(spark.createDataFrame(links, schema), spark.createDataFrame(facts, FACTS))) <= 9


def test_known_around_carries_over_chunks(spark):
    rows = [("g", p, (p * 10 if p % 5 == 0 else None)) for p in range(-20, 60)] + [("h", 3, None)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    out = K.known_around(df, ["k"], "p", "v", F.floor(F.col("p") / 7).cast("bigint"), {"v": F.max("v")}).collect()
    for r in out:
        if r.k == "g":
            assert r.below == r.p // 5 * 50 and r.all_v == 550
            assert r.above == (-(-r.p // 5) * 50 if r.p <= 55 else None)
        else:
            assert (r.below, r.above, r.all_v) == (None, None, None)
    assert len(out) == 81
