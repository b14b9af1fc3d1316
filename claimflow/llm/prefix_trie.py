"""Prefix trie of conversations: burst tries whose containers are sorted and swept into nodes.

Distinct turn sequences stand as suffixes in containers under trie heads, all under the root at first. A container with too many
turns is burst by its next turn ids; the nodes on the way become the trie above the containers. Containers that are small enough
are sorted by their suffixes and swept once. No step needs a whole conversation, container or group in one place but
containers of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import hash_pair, stored, table

#: Turns that one task ranks or sums alone when a conversation is long.
CHUNK = 1024
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Every turn with its place from 1 and its 128-bit id: conv, place, t1, t2, chars.

    Turns are sorted over all conversations into ranges, which may split a conversation; a place is that in the range and the number
    of the conversation's turns in the ranges before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t1, t2 = hash_pair(role, text)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), t1.alias("t1"), t2.alias("t2"))
    order = "conv", "turn", "role", "text"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv", "t1", "t2", F.char_length("text").cast("long").alias("chars"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    ranged = stored(ranged, "turns")
    pieces = stored(ranged.groupBy("conv", "range").agg(F.count("*").alias("n")), "pieces")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # a range's end splits one conversation at most, so these are no more than there are ranges
    later = pieces.withColumn("before", before).where("before IS NOT NULL").select("conv", "range", "before")
    local = F.row_number().over(Window.partitionBy("conv", "range").orderBy("at"))
    placed = ranged.withColumn("local", local).join(F.broadcast(later), ["conv", "range"], "left")
    return placed.select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "t1", "t2", "chars")


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Rows (conv, depth, t1, t2, chars) with the 128-bit digest p1, p2 of the turns up to each, q1, q2 of those before it, and ``total``, their characters.

    A digest is the exclusive or of hashes of the turns with their depths, so chunks of a long conversation are summed
    apart and put together.
    """
    h1, h2 = hash_pair(F.col("depth"), F.col("t1"), F.col("t2"))
    hashed = rows.select("conv", "depth", "t1", "t2", "chars", h1.alias("h1"), h2.alias("h2"), F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    sums = [F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"), F.sum("chars").alias("chunk_chars")]
    chunks = hashed.groupBy("conv", "chunk").agg(*sums)
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv", "chunk", F.bit_xor("c1").over(earlier).alias("b1"), F.bit_xor("c2").over(earlier).alias("b2"), F.sum("chunk_chars").over(earlier).alias("sofar")).where("chunk > 0")
    upto = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.withColumns({"p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto), "total": F.sum("chars").over(upto)})
    zero = F.lit(0).cast("long")
    full = inside.join(chunks, ["conv", "chunk"], "left").select(
        "conv", "depth", "t1", "t2", "chars", "h1", "h2",
        F.col("p1").bitwiseXOR(F.coalesce("b1", zero)).alias("p1"), F.col("p2").bitwiseXOR(F.coalesce("b2", zero)).alias("p2"),
        (F.col("total") + F.coalesce("sofar", zero)).alias("total"),
    )
    return full.select("conv", "depth", "t1", "t2", "chars", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "total")


def burst(members: DataFrame, rows: DataFrame, most_turns: int) -> DataFrame:
    """Heads of all sequences: conv, weight, length, depth (of the head), p1, p2 (its digest), alone.

    All begin under the root. As long as sequences that go on under one head hold over ``most_turns`` turns, that container
    is burst by its next turn ids, 1 in the first round, then 2, 4 and so on, so rounds grow with the logarithm of the
    longest conversation. A sequence that goes on alone under its head is burst no further (``alone``).
    """
    zero = F.lit(0).cast("long")
    held = members.withColumns({"depth": zero, "p1": zero, "p2": zero, "alone": F.lit(False)})
    step = 1
    while True:
        open_ = F.col("length") > F.col("depth")
        sizes = held.where(open_).groupBy("depth", "p1", "p2").agg(F.count("*").alias("n"), F.sum(F.col("length") - F.col("depth")).alias("turns"))
        sized = stored(held.drop("alone").join(sizes, ["depth", "p1", "p2"], "left").withColumn("alone", open_ & (F.col("n") == 1)), "heads")
        large = sized.where(open_ & (F.col("n") > 1) & (F.col("turns") > most_turns))
        if large.isEmpty():
            return sized.select("conv", "weight", "length", "depth", "p1", "p2", "alone")
        going = large.select("conv", "weight", "length", F.least("length", F.col("depth") + step).alias("depth"))
        moved = going.join(rows.select("conv", "depth", "p1", "p2"), ["conv", "depth"])
        rest = sized.where(~(open_ & (F.col("n") > 1) & (F.col("turns") > most_turns)))
        same = ["conv", "weight", "length", "depth", "p1", "p2"]
        held = rest.select(*same).unionByName(moved.select(*same)).withColumn("alone", F.lit(False))
        step *= 2


def swept(suffixes: DataFrame) -> DataFrame:
    """Nodes under the heads of sorted containers, and a row of depth -1 for each head, with its sums.

    ``suffixes`` has head, p1, p2, depth, conv, weight and the arrays turns and chars. Rows of a container follow each other in the order of
    their turns: what a sequence shares with the one before is the path that stays open, the rest of that is closed.
    """
    kind = f"{NODES}, q1 long, q2 long, top boolean, ends long"

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "chars", "ends"]
        head, before, path, nodes = None, [], [], []

        def close(upto: int) -> None:
            while len(path) > upto:
                node = path.pop()
                if not node["n_children"]:
                    node["n_leaves"] = 1
                node["saved"] += (node["n_convs"] - 1) * node["chars"] if node["depth"] > head[0] else 0
                if path:
                    over = path[-1]
                    node["parent"] = over
                    over["n_children"] += 1
                    over["n_convs"] += node["n_convs"]
                    over["n_leaves"] += node["n_leaves"]
                    over["saved"] += node["saved"]
                    over["conv_id"] = min(over["conv_id"], node["conv_id"])
                nodes.append(node)

        def finished() -> list[tuple]:
            close(0)
            out = [
                (n["conv_id"], n["depth"] if n["parent"] else -1, n["parent"]["conv_id"] if n["parent"] else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved"],
                 head[1], head[2], n["depth"] == head[0] + 1, n["ends"])
                for n in nodes
            ]
            nodes.clear()
            return out

        def opened(depth: int, conv: int, chars: int) -> dict:
            return dict(zip(names, (conv, depth, None, 0, 0, 0, 0, chars, None), strict=True))

        done: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.depth, row.p1, row.p2) != head:
                    if head:
                        done += finished()
                    head, before = (row.depth, row.p1, row.p2), []
                    path.append(opened(row.depth, row.conv, 0))
                turns = list(row.turns)
                same = next((i for i, (a, b) in enumerate(zip(before, turns, strict=False)) if a != b), min(len(before), len(turns)))
                close(1 + same)
                for i in range(same, len(turns)):
                    path.append(opened(row.depth + i + 1, row.conv, int(row.chars[i])))
                path[-1]["n_convs"] += row.weight
                path[-1]["ends"] = row.conv  # this sequence ends here; those above count it when the path closes
                before = turns
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=_COLUMNS).astype(_TYPES)
                done = []
        if head:
            done += finished()
        yield pd.DataFrame(done, columns=_COLUMNS).astype(_TYPES)

    return suffixes.mapInPandas(sweep, kind)


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "q1", "q2", "top", "ends"]
_TYPES = {c: "Int64" for c in _COLUMNS} | {"top": "boolean"}


def end_digests(classes: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each class: conv (the smallest), ends_sha256.

    ``classes`` has conv and member. Ids come sorted and are fed to the digest one by one, so a class of any size
    takes no memory; the digest itself has to see them in order.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, ids in batch.groupby("conv", sort=False)["member"]:
                text = ",".join(map(str, ids.tolist()))
                if conv == now:
                    state.update(f",{text}".encode())
                else:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["conv", "ends_sha256"])
        if state:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["conv", "ends_sha256"])

    return classes.repartition("conv").sortWithinPartitions("conv", "member").mapInPandas(digest, "conv long, ends_sha256 string")


def trie_nodes(sequences: DataFrame, all_convs: DataFrame, most_turns: int = 4096) -> DataFrame:
    """The trie of ``sequences`` (conv, depth from 1, t1, t2, chars); ``all_convs`` (conv) has every conversation, those without turns too.

    Columns as in :func:`conversation_trie`. Equal sequences are one class with a weight. Above the containers' heads nodes are sums over
    the classes that pass; a node's sums over its subtree are added up along one member's path: each node's share is held by the
    smallest class in it.
    """
    rows = stored(with_prefixes(sequences), "prefixes")
    whole = rows.groupBy("conv").agg(F.count("*").alias("length"), F.max(F.struct("depth", "p1", "p2", "total")).alias("end"))
    zero = F.lit(0).cast("long")
    ended = all_convs.join(whole, "conv", "left").select("conv", F.coalesce("length", zero).alias("length"), F.coalesce("end.p1", zero).alias("e1"), F.coalesce("end.p2", zero).alias("e2"))
    ended = stored(ended, "ends")
    classes = stored(ended.groupBy("length", "e1", "e2").agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "classes")
    digests = end_digests(ended.join(classes.select("length", "e1", "e2", F.col("conv").alias("least")), ["length", "e1", "e2"]).select(F.col("least").alias("conv"), F.col("conv").alias("member")))
    digests = stored(digests, "end-digests")
    rows = stored(rows.join(classes.select("conv", "weight", "length"), "conv"), "class-rows")

    heads = stored(burst(classes.select("conv", "weight", "length"), rows, most_turns), "heads").withColumnsRenamed({"depth": "head", "p1": "d1", "p2": "d2"})
    under = rows.join(heads.select("conv", "head", "d1", "d2", "alone"), "conv")

    # below the heads: chains of what goes on alone, and containers
    chains = under.where("alone AND depth > head").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("head") + 1, F.col("conv")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("chars"), "total", "length",
        "q1", "q2", (F.col("depth") == F.col("head") + 1).alias("top"), F.when(F.col("depth") == F.col("length"), F.col("conv")).alias("ends"),
    )
    finals = rows.where("depth = length").select(F.col("conv").alias("conv_id"), F.col("total").alias("final"))
    saved = (F.col("n_convs") - 1) * (F.col("final") - F.col("total") + F.col("chars"))
    chains = chains.join(finals, "conv_id").withColumn("saved_tokens", saved).drop("chars", "total", "length", "final")
    held = under.where("NOT alone AND depth > head").groupBy("d1", "d2", "head", "conv").agg(
        F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("depth", F.concat_ws("-", "t1", "t2").alias("turn"), "chars"))).alias("s")
    )
    held = held.select(F.col("head").alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), "conv", "weight", F.col("s.turn").alias("turns"), F.col("s.chars").alias("chars"))
    held = held.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "turns")
    below = stored(swept(held), "swept")
    summed = below.where("depth = -1").select("conv_id", "q1", "q2", "n_leaves", "saved_tokens")
    below = below.where("depth > 0").unionByName(chains)

    # the heads and what is above them, the root included
    root = heads.select("conv", "weight", "length", "head", zero.alias("depth"), zero.alias("chars"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    passed = under.where("depth <= head").select("conv", "weight", "length", "head", "depth", "chars", "p1", "p2", "q1", "q2").unionByName(root)
    passed = stored(passed, "passed")
    above = passed.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.count("*").alias("members"), F.max("length").alias("longest"), F.max(F.when(F.col("length") == F.col("depth"), F.col("conv"))).alias("ends"),
    )
    above = stored(above, "above")
    # a container's sums are held by its smallest class at the head, a chain's by its class
    tails = summed.select(F.col("conv_id").alias("conv"), "n_leaves", "saved_tokens")
    tails = tails.unionByName(chains.where("top").select(F.col("conv_id").alias("conv"), "n_leaves", "saved_tokens"))
    shares = passed.join(above.select("depth", "p1", "p2", "conv_id", "n_convs", "longest"), ["depth", "p1", "p2"])
    holds = F.col("conv") == F.col("conv_id")
    shares = shares.select(
        "conv", "head", "depth", "p1", "p2",
        F.when(holds & (F.col("depth") > 0), (F.col("n_convs") - 1) * F.col("chars")).otherwise(zero).alias("own_saved"),
        (holds & (F.col("longest") == F.col("depth"))).cast("long").alias("own_leaves"),
    ).join(tails, "conv", "left")
    at_head = F.col("depth") == F.col("head")
    shares = shares.withColumns({
        "own_saved": F.col("own_saved") + F.when(at_head, F.coalesce("saved_tokens", zero)).otherwise(zero),
        "own_leaves": F.col("own_leaves") + F.when(at_head, F.coalesce("n_leaves", zero)).otherwise(zero),
    })
    onward = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = shares.withColumns({"onward_saved": F.sum("own_saved").over(onward), "onward_leaves": F.sum("own_leaves").over(onward)})
    sums = sums.groupBy("depth", "p1", "p2").agg(F.sum("onward_saved").alias("saved_tokens"), F.sum("onward_leaves").alias("n_leaves"))
    children = above.where("depth > 0").select("q1", "q2", (F.col("depth") - 1).alias("depth")).unionByName(below.where("top").select("q1", "q2", (F.col("depth") - 1).alias("depth")))
    children = children.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "depth").agg(F.count("*").alias("n_children"))
    upper = above.join(sums, ["depth", "p1", "p2"]).join(children, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    same = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "q1", "q2", "ends"]
    nodes = upper.select(*same, F.lit(None).cast("long").alias("known"), F.lit(True).alias("top")).unionByName(below.select(*same, F.col("parent_conv_id").alias("known"), "top"))
    parents = above.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("over"))
    tops = nodes.where("top").join(parents, ["depth", "q1", "q2"], "left").withColumn("known", F.col("over")).drop("over")
    nodes = stored(tops.unionByName(nodes.where("NOT top")), "nodes")
    ending = nodes.where("ends IS NOT NULL").join(digests.withColumnRenamed("conv", "ends"), "ends")
    nodes = ending.unionByName(nodes.where("ends IS NULL").withColumn("ends_sha256", F.lit(_EMPTY_SHA)))
    return nodes.select("conv_id", "depth", F.col("known").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = 4096
) -> DataFrame:
    """Nodes of the prefix trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of turns (role, text) with which conversations begin; the root is the empty one. saved_tokens is the sum over the
    subtree of (n_convs - 1) times the code points of a node's last text; ends_sha256 the SHA-256 of the ascending,
    comma-joined ids of the conversations that end there. ``most_turns`` bounds the containers that are swept.

    Turns are ordered by number, null first, then by role and text. Null role or text: empty. Rows with null conversation
    id belong to no conversation and are left out. Repeated rows are turns of their own. No rows: no nodes. Other columns are ignored.
    """
    turns = stored(ordered_turns(conversations, conv_col, turn_col, role_col, text_col), "ordered")
    sequences = turns.withColumnRenamed("place", "depth")
    return trie_nodes(sequences, turns.select("conv").distinct(), most_turns)


def forked(turns: DataFrame, block: int, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as forks of the first of their block of ids: sequences (conv, depth, t1, t2, chars) and all ids (conv).

    Conversation c takes the first h turns of c - c % block, h being the crc32 of its decimal id modulo ``most_shared`` + 1, then its own
    turns after its first h. ``turns`` has conv, place, t1, t2, chars.
    """
    counted = turns.groupBy("conv").agg(F.max("place").alias("n"))
    h = (F.crc32(F.col("conv").cast("string")) % (most_shared + 1)).alias("h")
    asked = counted.select("conv", h, (F.col("conv") - F.col("conv") % block).alias("base"))
    lengths = counted.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = stored(asked.join(lengths, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0)))), "forks")
    own = turns.join(known.select("conv", "h", "shared"), "conv").where("place > h")
    own = own.select("conv", (F.col("shared") + F.col("place") - F.col("h")).cast("long").alias("depth"), "t1", "t2", "chars")
    # a base has 2 * block - 1 forks at most, and few of its turns are shared
    first = turns.where(F.col("place") <= most_shared).withColumnRenamed("conv", "base")
    shared = first.join(known.select("conv", "base", "h"), "base").where("place <= h").select("conv", F.col("place").cast("long").alias("depth"), "t1", "t2", "chars")
    return own.unionByName(shared), known.select("conv")


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Trie nodes of all ``conversations``, each rebuilt as a fork of the first of its hundred."""
    rows = table(spark, sf_dir, "conversations")
    turns = stored(ordered_turns(rows, "conv_id", "turn", "role", "text"), "ordered")
    return trie_nodes(*forked(turns, 100, 5))


#: crc32 of a decimal id: bit by bit over its digits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH seqs AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), forks AS (SELECT conv_id, s, {_CRC} % 6 AS h FROM seqs),
rebuilt AS MATERIALIZED (
  SELECT f.conv_id, list_concat(coalesce(b.s, [])[1 : h], f.s[h + 1 :]) AS s FROM forks f LEFT JOIN seqs b ON b.conv_id = f.conv_id - f.conv_id % 100
), prefixes AS MATERIALIZED (
  SELECT conv_id, s, d, s[1 : d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(length(last(p)[d].t), 0) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
spread AS (
  SELECT p[1 : up] AS p, CASE WHEN d > 0 THEN (n - 1) * chars ELSE 0 END AS saved, leaf
  FROM (SELECT a.p, a.d, a.n, a.chars, k.n IS NULL AS leaf, unnest(range(a.d + 1)) AS up FROM nodes a LEFT JOIN kids k ON k.p = a.p)
), sums AS (SELECT p, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (leaf) AS leaves FROM spread GROUP BY p)
SELECT a.conv_id, a.d AS depth, o.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums s ON s.p = a.p LEFT JOIN kids k ON k.p = a.p LEFT JOIN nodes o ON a.d > 0 AND o.p = a.p[1 : a.d - 1]
"""
