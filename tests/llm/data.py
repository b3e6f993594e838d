"""Documents with all the awkward cases."""

import random


def awkward(spark, columns="doc_id long, text string, lang string, source string, n_chars long, key string, value long"):
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns whose names operators might use themselves."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    passage = " ".join(word() for _ in range(70))
    texts: list = [None, "", " \n\t ", "one two", "One  TWO"]
    texts += base + base[:3]
    texts += [b.replace(b.split()[5], "changed") for b in base[:4]]
    texts += [f"{a[:200]} {passage} {b[:150]}" for a, b in zip(base, base[1:])]
    texts += [" ".join(["again and again we say this"] * 40), " ".join(word() for _ in range(30000)), "x" * 200000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "k", i) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base[1], None, None, None, None, None), (3, "other text under a used id", "en", "s1", 5, "k", 1)]
    return spark.createDataFrame(rows, columns), rows
