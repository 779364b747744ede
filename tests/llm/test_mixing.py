"""op5 with ids missing or repeated, other repeats, and clashing columns."""

import re
from collections import Counter

from gridloom.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark):
    rows = [(None, f"no id here but words {k} " * (3 + k % 5), "a" if k % 3 else None) for k in range(40)] + [(7, "the same id and text", "b")] * 6 + [(7, "the same id, other text", "b"), (8, None, "b"), (9, "", None)]
    return rows, spark.createDataFrame([(*r, f"row{k}", k, 1) for k, r in enumerate(rows)], "doc_id long, text string, source string, size string, taken int, key int")


def test_every_row_gets_its_part(spark):
    rows, docs = _docs(spark)
    for repeat in (1, 2, 3):
        got = mixing.mix(docs, repeat=repeat, share=0.9 * repeat).collect()
        assert len(got) == len(rows)
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
        assert all(0 <= r["taken"] <= repeat * r["size"] for r in got)
        for s in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8 * mixing.BLOCK and own[0]["target"] <= repeat * own[0]["source_size"]


def test_documents_without_ids_are_dealt_to_shards(spark):
    _, docs = _docs(spark)
    keys = {r["ident"] for r in mixing.sizes(docs).collect()}
    assert len(keys) == 40 + 3


def test_mixed_keeps_clashing_columns(spark):
    rows, docs = _docs(spark)
    got = mixing.mixed(docs).collect()
    assert got and set(got[0].asDict()) == set(docs.columns)
    for r in got:
        i, t, s = rows[r["taken"]]
        assert (r["doc_id"], r["source"], r["size"]) == (i, s, f"row{r['taken']}") and set(WORD.findall(r["text"])) <= set(WORD.findall(t))
    assert mixing.mixed(docs.where("false")).count() == 0


def test_stored_tables_can_be_released(spark):
    import os

    t = common.stored(spark.range(5), "short-lived")
    path = t.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and t.count() == 5
    root = common.shared_dir(spark, "x").rsplit("/", 1)[0]
    assert root.endswith(spark.sparkContext.applicationId) and path.startswith(root.removeprefix("file://"))
