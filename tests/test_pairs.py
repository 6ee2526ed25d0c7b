"""One plan from words to pairs against the operators that it is made of."""

import random

from pyspark.sql import functions as F

from idsieve.operators import layout

GOOD = ["AB12345671UTO8504124F3201141<<<<<<<<<<<<<<04", "J0189638<8IND0708030M1503140<<<<<<<<<<<<<<04"]
NAMES = ["P<UTOERIKSSON<<ANNA".ljust(44, "<"), "V<UTOERIKSSON<<ANNA".ljust(44, "<"), "VNUTOERIKSSON<<ANNA".ljust(44, "<")]


def pages(seed):
    r = random.Random(seed)
    for doc in range(150):
        for page in range(1, r.randrange(2, 4)):
            y = 100.0
            for row in range(r.randrange(1, 7)):
                text = r.choice([r.choice(NAMES), r.choice(NAMES), r.choice(GOOD), r.choice(GOOD), r.choice(GOOD)[:9] + "9" + GOOD[0][10:], r.choice(GOOD).replace("0", "O", 1), "REPUBLIC OF UTOPIA", "short"])
                cuts = sorted({0, len(text), *(r.randrange(len(text)) for _ in range(r.randrange(3)))})
                x = r.choice([10.0, 30.0, 30.0, 120.0])
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    width = 8.0 * (b - a)
                    yield (f"d{doc}", page, 10 * row + n, text[a:b], 90.0, x, y + r.choice([0, 1, 3, 5]), width, 12.0)
                    x += width + r.choice([2, 10, 59, 61])
                y += r.choice([8.0, 30.0, 60.0, 60.0, 130.0])


def test_one_plan_equals_its_parts(spark):
    words = layout.boxed(spark.createDataFrame(list(pages(3)), "doc_id string, page int, ord int, text string, confidence double, x double, y double, width double, height double"))
    for visa in (False, True):
        parts = layout.segments(layout.visual_rows(words)).withColumn("ord", F.col("row") * 1000 + F.col("segment"))
        want = {(r.doc_id, r.line1, r.line2, r.score) for r in layout.machine_pairs(parts, visa).collect()}
        out = layout.pairs_of_documents(words, visa)
        rows = out.collect()
        assert len(rows) == 150 and {(r.doc_id, r.line1, r.line2, r.score) for r in rows if r.line1} == want and len(want) > 3
        assert {c.role for r in rows for c in r.candidates} >= {"line1", "line2"}
        assert layout.pairs_of_documents(words, visa)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
