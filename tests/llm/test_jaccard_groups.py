"""op1: which rows of prefixes go on into rounds, and how often they are shuffled."""

import random

from gridloom.llm import jaccard_join


def _rows(spark, rows):
    return jaccard_join.stored(spark.createDataFrame(rows, "c long, n int, i int, t long"), "rows")


def test_rows_that_may_be_first_are_all_kept(spark):
    rng = random.Random(3)
    own = {(rng.randrange(300), rng.randrange(2500)): None for _ in range(4000)}
    size = [rng.randint(1, 90) for _ in range(300)]
    rows = [(c, size[c], rng.randint(0, size[c] // 4), t) for c, t in own]
    got = {(r["t"], r["c"]): r for r in jaccard_join._grouped(_rows(spark, rows)).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    assert got.keys() == {(t, c) for c, _, _, t in rows if len(by[t]) > 1}
    near = lambda x, y: 7 * min(x[1] - x[2], y[1] - y[2]) >= 3 * (x[1] + y[1])
    wanted = {(x[3], x[0]): any(near(x, y) for y in by[x[3]] if y is not x) for x in rows if len(by[x[3]]) > 1}
    assert all(got[k]["first"] for k, v in wanted.items() if v) and all(got[k]["k"] == len(by[k[0]]) for k in got)
    assert all(got[k]["first"] == v for k, v in wanted.items() if got[k]["k"] == 2) and not all(wanted.values())


def test_rows_are_shuffled_once(spark):
    df = jaccard_join._grouped(_rows(spark, [(c, 20, 0, c // 2) for c in range(400)]))
    assert len(df.collect()) == 400
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2  # the reused one is named again


def test_chance_meetings_stay_out_of_the_rounds(spark, monkeypatch):
    """Texts of unlike lengths made rows in every shuffle of a round."""
    kept, most = jaccard_join.stored, {}

    def watched(df, name):
        out = kept(df, name)
        most[name] = max(most.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    rows = []
    for k in range(20):  # a text and its six parts: every shingle is in two texts, which are too unlike in length to link
        words = [f"s{k}.{j}" for j in range(64)]
        rows += [(10 * k, " ".join(words)), *((10 * k + 1 + j, " ".join(words[10 * j : 10 * j + 14])) for j in range(6))]
    # A pair that links.
    rows += [(1000, " ".join(f"z{j}" for j in range(60))), (1001, " ".join(f"z{j}" for j in range(58)))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["component_id"] != r["doc_id"]} == {1001}
    assert most["prefix-groups"] > 200 and most["company"] == 2
