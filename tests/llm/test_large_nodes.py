"""Near copies share nodes in most trees: their pairs are checked once each, and members aren't sent once for each tree."""

import random

import numpy as np
from pyspark.sql import functions as F

from claimflow.llm import jaccard_join as J
from claimflow.llm.quality_rules import WordHashes

CELL_ROWS = 8


def _classes(spark, depth):
    rng, forest, hashes = random.Random(3), J.Forest(6, depth), WordHashes()
    base = [f"w{i}" for i in range(120)]
    texts = []
    for n in range(70):
        words = list(base)
        words[rng.randrange(120)] = f"x{n}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(base, k=30)) for _ in range(20)]
    drawn = [np.frombuffer(forest.signature(J.shingle_set(t, hashes, 5)), dtype=np.uint32).reshape(6, depth) for t in texts]
    rows = [(n, -n, bytearray(x.tobytes())) for n, x in enumerate(drawn)]
    return forest, drawn, spark.createDataFrame(rows, "h1 long, h2 long, signature binary")


def _same(x, y, depth):
    return [bool((a[:depth] == b[:depth]).all()) for a, b in zip(x, y, strict=True)]


def test_each_pair_of_a_node_is_checked_once_and_large_nodes_are_dealt_once(spark):
    forest, drawn, classes = _classes(spark, 3)
    for depth, open_ in ((3, None), (2, {n for n in range(90) if n % 3})):
        marked = None if open_ is None else spark.createDataFrame([(n, -n) for n in open_], "h1 long, h2 long")
        dealt, members = J.node_cells(classes, forest, depth, marked, CELL_ROWS)
        cells = dealt.join(members, ["h1", "h2"]).toPandas()
        got = []
        for _, cell in cells.groupby(["key", "i", "j"]):
            ids = cell["h1"].to_numpy()
            got += [tuple(sorted((ids[a], ids[b]))) for a, b in zip(*np.nonzero(J.new_pairs(cell)), strict=True)]
        pairs = [(a, b) for a in range(90) for b in range(a + 1, 90) if any(_same(drawn[a], drawn[b], depth))]
        if open_ is not None:
            pairs = [(a, b) for a, b in pairs if (a in open_ or b in open_) and not any(_same(drawn[a], drawn[b], depth + 1))]
        assert sorted(got) == pairs and pairs
        nodes = classes.select(F.explode(forest.prefixes(depth)).alias("key")).groupBy("key").count().where("count > 1").collect()
        apart = sum(n["count"] * -(-n["count"] // CELL_ROWS) for n in nodes)
        assert len(cells) < apart / 2
