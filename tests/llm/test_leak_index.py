"""The Hamming index of a benchmark is never broadcast; prints are majorities of bits."""

import re

from claimflow.llm.decontamination import find_leaks, simhash


def test_spread_items_are_merged_not_broadcast(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "other words " * 20)], "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and re.search(r"\bbits#", line)]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert [(r["id"], r["item_id"], r["start"], r["similarity"]) for r in found.collect()] == [(1, 7, 2, 1.0)]


def test_prints_equal_counted_bits(spark):
    rows = [(k, f"word{i * k % 97}") for k in range(1, 9) for i in range(k * 5)]
    frame = spark.createDataFrame(rows, "k int, word string")
    hashes = {r["word"]: r["h"] for r in frame.selectExpr("word", "xxhash64(word) AS h").distinct().collect()}
    for r in simhash(frame, ["k"], "word").collect():
        mine = [hashes[w] for k, w in rows if k == r["k"]]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mine) > len(mine))
        assert r["print"] % 2**64 == want
