"""op6 against brute force, with hot lines, repeated rows and null ids, and the plan that streams first occurrences."""

import random

import pytest

from gridloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    first, docs = {}, {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else ():
            if len(k := key(x)) >= 10:
                first[k] = min(first.get(k, i), i)
                docs.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(docs.get(key(x), ())) < 2 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    pool = [f"line number {k} of them" for k in range(60)]
    rows = [(rnd.randrange(n), "\n".join(rnd.choice(["A common line here", " a COMMON line HERE\t", "short", "", f"own {k} of this row", rnd.choice(pool)]) for _ in range(rnd.randrange(12)))) for k in range(n)]
    return rows + rows[:20] + [rows[3]] * 40 + [(None, pool[0] + "\nA common line here"), (None, None), (5, None), (6, ""), (n + 1, "A common line here\n" * 3000 + "end")]


@pytest.mark.parametrize("least", [line_dedup.LEAST_SEEN, 2])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(line_dedup, "LEAST_SEEN", least)
    for seed in (1, 2):
        rows = rows_of(seed)
        docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, pos string").repartition(5)
        out = line_dedup.apply_runs(docs, line_dedup.dropped_runs(docs)).collect()
        assert sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"] or "") for r in out), key=str) == brute(rows)
        assert {(r["runs"], r["pos"]) for r in out} == {(1, "z")}


def test_hot_lines_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_SEEN", 30)
    docs = spark.createDataFrame([(k, f"the hot line of all\nown line number {k}") for k in range(500)], "doc_id long, text string")
    keys = line_dedup.stored(line_dedup.line_keys(docs), "t")
    assert line_dedup.hot_keys(keys, 4).count() == 1
    found = line_dedup.streamed(keys, 4)
    assert found.where("open").select("doc_id").distinct().count() == 4 and found.where("not open").count() == 496


def test_plan_streams_over_the_secondary_sort(spark):
    docs = spark.createDataFrame([(k, "a line long enough\n" * 2) for k in range(9)], "doc_id long, text string")
    plan = line_dedup.streamed(line_dedup.stored(line_dedup.line_keys(docs), "t"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning" not in plan and plan.count("Exchange rangepartitioning") == 1
    sort = next(x for x in plan.splitlines() if "Sort [h1" in x)
    assert [c in sort for c in ("split", "doc_id", "tag", "pos")] == [True] * 4 and "Window" in plan
