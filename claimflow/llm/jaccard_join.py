"""N-gram Jaccard join: a MinHash LSH forest, then exact verification, then groups of linked documents.

Documents with the same shingles are one class with one representative, so
copies are never compared. Each representative has ``trees`` signatures, sequences of minima, and
stands in a prefix trie of each. All start at the same prefix, the longest at which a lone pair at the threshold meets with
the recall asked for; those that share it in some trie are a node, and its pairs are checked exactly. The
similarities found tell how many links of a document the prefixes so far are likely to have missed. Documents for which that
share is too large have their prefixes shortened, a minimum at a time, and are checked against what
joins them in the larger nodes, until their own recall reaches its target. Nodes
are dealt into cells of bounded size; a cell checks its pairs, each
pair at the longest prefix and in the first tree it shares, and gives back counts and one edge
for each document, never the pairs. Near copies share nodes in most trees: large nodes with common members are dealt
together, once for all trees, where that takes fewer cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import LOWER, NO_ID, UPPER, broadcast_if_small, stored, table, text_hash, without, words_of
from claimflow.llm.quality_rules import WordHashes

_LOWERED = str.maketrans(UPPER, LOWER)
#: In place of a tree's number: a cell of large nodes that are dealt together.
HOME = -1


def shingle_set(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles; of all its words if they are fewer."""
    own = hashes.of(words_of(text.translate(_LOWERED)))
    if not len(own):
        return own
    starts = max(len(own) - size + 1, 1)
    rolled = np.full(starts, len(own) if len(own) < size else size, dtype=np.uint64)
    for i in range(min(size, len(own))):
        rolled = (rolled ^ own[i : i + starts]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


def prefix_depth(trees: int, most_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with chance ``recall``."""
    depth = most_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def chance(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """How likely a pair of that Jaccard similarity shares a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


class Forest:
    """Signatures of shingle sets: for each of ``trees`` trees the minima of ``depth`` random orders."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(20240229)
        self.trees, self.depth = trees, depth
        self.times = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.mask = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> bytes:
        own, minima = (shingles >> np.uint64(32)).astype(np.uint32), np.empty(len(self.times), dtype=np.uint32)
        step = max(1, 250_000 // len(own))
        for a in range(0, len(minima), step):
            mixed = own[None, :] ^ self.mask[a : a + step, None]
            mixed *= self.times[a : a + step, None]
            minima[a : a + step] = mixed.min(axis=1)
        return minima.tobytes()

    def prefixes(self, depth: int) -> Column:
        """A 64-bit key for the prefix of ``depth`` minima in each tree, from the column ``signature``."""
        keys = [F.xxhash64(F.lit(t), F.substring("signature", 4 * t * self.depth + 1, 4 * depth)) for t in range(self.trees)]
        return F.array(*keys)


def sketches(docs: DataFrame, forest: Forest, size: int) -> DataFrame:
    """id, th, n (distinct shingles), h1 and h2 (digest of the set), signature."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, drawn = [], [], []
            for text in batch["text"]:
                own = shingle_set(text, hashes, size)
                counts.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                drawn.append(forest.signature(own) if len(own) else None)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "n": counts, "h1": halves[:, 0], "h2": halves[:, 1], "signature": drawn})

    return docs.mapInPandas(sketch, "id long, th long, n long, h1 long, h2 long, signature binary")


def by_cell(batches: Iterator[pd.DataFrame], check: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """``check`` of each run of rows with one cell; rows come sorted by cell, and a cell is small."""
    rest: pd.DataFrame | None = None
    out, held = [], 0
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        cell = batch[["key", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = check(batch.iloc[a:b])
            if found is not None:
                out.append(found)
                held += len(found)
        rest = batch.iloc[cuts[-1] :]
        if held > 5000:
            yield pd.concat(out, ignore_index=True)
            out, held = [], 0
    if rest is not None and len(rest) and (found := check(rest)) is not None:
        out.append(found)
    if out:
        yield pd.concat(out, ignore_index=True)


def new_pairs(cell: pd.DataFrame) -> np.ndarray:
    """Which pairs (row below column) of a cell are checked here.

    Pairs with an open document that share no longer prefix in any tree and none of this length in an
    earlier one; across the blocks if the cell has two. Pairs of one home are checked there, if they share a prefix in any tree, and in no tree's node.
    """
    keys, longer = np.stack(cell["keys"].to_list()), np.stack(cell["longer"].to_list())
    tree, block, open_ = int(cell["tree"].iloc[0]), cell["block"].to_numpy(), cell["open"].to_numpy(bool)
    pairs = np.triu(np.ones((len(cell), len(cell)), dtype=bool), 1)
    if not open_.all():
        pairs &= open_[:, None] | open_[None, :]
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        pairs &= block[:, None] != block[None, :]
    home = cell["home"].to_numpy()
    if tree == HOME:
        pairs &= np.logical_or.reduce([own[:, None] == own[None, :] for own in keys.T])
    else:
        pairs &= (home[:, None] != home[None, :]) | (home == 0)[:, None]
    for own in (*longer.T, *keys.T[: max(tree, 0)]):
        if not pairs.any():
            break
        pairs &= own[:, None] != own[None, :]
    return pairs


def common_shingles(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs asked for."""
    both = np.zeros(pairs.shape, dtype=np.int64)
    if pairs.sum() <= 64:
        for a, b in zip(*np.nonzero(pairs), strict=True):
            both[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return both
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[term] > 1
    column = (np.cumsum(times > 1) - 1)[term[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += (held @ held.T).astype(np.int64)
    return both


def linked(cell: pd.DataFrame, numerator: int, denominator: int, forest: Forest) -> pd.DataFrame | None:
    """For each member with links: the member of the cell it hangs on, the number of links, copies counted, and for
    each depth how many more links like these a prefix of that depth is likely to miss."""
    pairs = new_pairs(cell)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in cell["shingles"]]
    size, copies = np.array([len(s) for s in sets]), cell["copies"].to_numpy()
    pairs &= denominator * np.minimum(size[:, None], size[None, :]) >= numerator * np.maximum(size[:, None], size[None, :])
    both = common_shingles(sets, pairs)
    links = pairs & (denominator * both >= numerator * (size[:, None] + size[None, :] - both))
    if not links.any():
        return None
    at = np.nonzero(links)
    similarity = both[at] / (size[at[0]] + size[at[1]] - both[at])
    links |= links.T
    count = links @ copies
    missed = np.zeros((len(cell), forest.depth))
    for depth in range(1, forest.depth + 1):
        odds = 1 / chance(similarity, depth, forest.trees) - 1
        for one, other in (at, at[::-1]):
            missed[:, depth - 1] += np.bincount(one, weights=odds * copies[other], minlength=len(cell))
    root = np.arange(len(cell))
    while True:  # the least member that links reach
        least = np.minimum(root, np.where(links, root[None, :], len(root)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    own = np.flatnonzero(count)
    h1, h2 = cell["h1"].to_numpy(), cell["h2"].to_numpy()
    return pd.DataFrame({"a1": h1[own], "a2": h2[own], "b1": h1[root[own]], "b2": h2[root[own]], "links": count[own], "missed": list(missed[own])})


def components(edges: DataFrame) -> DataFrame:
    """The least node each node is connected to: c, label. Labels spread along edges and jump to their labels' labels.

    ``edges`` has structs a and b. Every round is a written table; labels only fall, so it ends, and jumps make the
    rounds grow with the logarithm of a path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["c"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["c"] == near["a"]).select("c", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("c").alias("at"), F.col("label").alias("far"))
        moved = spread.join(jump, spread["new"] == jump["at"], "left")
        moved = stored(moved.select("c", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old")), "labels")
        changed = moved.where("label != old").limit(1).count()
        labels = moved.drop("old")
        if not changed:
            return labels


def shared_homes(large: DataFrame) -> DataFrame | None:
    """key and home of the nodes ``large`` (h1, h2, key, members) that are dealt together; None if there are none.

    Those are nodes linked by common members, if the square of all their members isn't above the sum of the squares of each node's.
    """
    links = large.select("key", F.min("key").over(Window.partitionBy("h1", "h2")).alias("least")).where("key != least")
    links = stored(links.select(F.struct("key").alias("a"), F.struct(F.col("least").alias("key")).alias("b")).distinct(), "node-links")
    if links.isEmpty():
        return None
    labels = components(links).select(F.col("c.key").alias("key"), F.col("label.key").alias("home"))
    rows = large.join(broadcast_if_small(labels), "key")
    squares = rows.groupBy("home", "key").agg(F.first("members").alias("n")).groupBy("home").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    sizes = rows.select("home", "h1", "h2").distinct().groupBy("home").agg(F.count("*").alias("n"))
    fewer = squares.join(sizes, "home").where(F.col("n") * F.col("n") <= F.col("apart")).select("home")
    return stored(labels.join(fewer, "home").select("key", "home"), "homes")


def node_cells(classes: DataFrame, forest: Forest, depth: int, open_: DataFrame | None, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members of the nodes at ``depth`` that may hold new pairs, dealt into cells: key, i, j, block, tree, h1, h2; and for each member h1, h2, open, keys, longer, home.

    ``open_`` (h1, h2) names the documents whose prefixes are shortened to this depth; None: all of them. Of
    the nodes those count that an open document is in and that a longer prefix doesn't hold whole. Nodes of over ``cell_rows`` members that
    common members link have one home (:func:`shared_homes`), whose members are dealt once, and no longer by nodes of that home alone.
    """
    keyed = classes.select("h1", "h2", forest.prefixes(depth).alias("keys"), "signature")
    none = F.array().cast("array<bigint>")
    longer = none if open_ is None else forest.prefixes(depth + 1)
    keyed = keyed.select("h1", "h2", "keys", longer.alias("longer"))
    if open_ is None:
        keyed = keyed.withColumn("open", F.lit(True))
        placed = keyed.select("h1", "h2", F.posexplode("keys").alias("tree", "key"))
        crowded = placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    else:
        marked = broadcast_if_small(open_.select(F.col("h1").alias("o1"), F.col("h2").alias("o2")))
        keyed = keyed.join(marked, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left")
        keyed = keyed.select("h1", "h2", "keys", "longer", F.col("o1").isNotNull().alias("open"))
        children = keyed.select("h1", "h2", "open", F.posexplode(F.arrays_zip("keys", "longer")).alias("tree", "z"))
        placed = children.select("h1", "h2", "open", "tree", F.col("z.keys").alias("key"), F.col("z.longer").alias("child"))
        # the other nodes go before any shuffle
        looked_at = stored(keyed.where("open").select(F.explode("keys").alias("key")).distinct(), "open-nodes")
        placed = placed.join(broadcast_if_small(looked_at), "key", "left_semi")
        crowded = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("child").alias("a"), F.max("child").alias("b"))
        crowded = crowded.where("a != b").select("key", "members")
        placed = placed.drop("open", "child")
    met = stored(placed.join(crowded, "key"), "met")
    homes = shared_homes(met.where(F.col("members") > cell_rows))
    if homes is None:
        met = met.withColumn("home", F.lit(0).cast("long"))
    else:
        own = F.coalesce(F.max("home").over(Window.partitionBy("h1", "h2")), F.lit(0))  # a member's large nodes have one home or none
        met = stored(met.join(broadcast_if_small(homes), "key", "left").withColumn("home", own), "met")
    members = met.groupBy("h1", "h2").agg(F.first("home").alias("home"))
    members = stored(keyed.join(members, ["h1", "h2"]).select("h1", "h2", "open", "keys", "longer", "home"), "members")
    if homes is not None:
        at_home = members.where("home != 0").select("h1", "h2", "home")
        size = at_home.groupBy("home").agg(F.count("*").alias("members"))
        at_home = at_home.join(broadcast_if_small(size), "home").select("h1", "h2", F.lit(HOME).alias("tree"), F.col("home").alias("key"), "members")
        met_there = met.groupBy("key").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a != 0 AND a = b").select("key")
        met = met.join(broadcast_if_small(stored(met_there, "met-at-home")), "key", "left_anti").select(at_home.columns).unionByName(at_home)
    blocks = F.ceil(F.col("members") / F.lit(cell_rows)).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h2", "h1"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tree", "h1", "h2"), members


def verified_links(rows: DataFrame, classes: DataFrame, cells: DataFrame, members: DataFrame, forest: Forest, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Exact links of the new pairs of all cells of :func:`node_cells`: what :func:`linked` gives, as a written table."""

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def check(cell: pd.DataFrame) -> pd.DataFrame | None:
            pairs = new_pairs(cell)
            own = pairs.any(axis=0) | pairs.any(axis=1)
            return cell.loc[own, ["key", "i", "j", "block", "tree", "h1", "h2", "open"]] if own.any() else None

        yield from by_cell(batches, check)

    grouped = cells.join(members, ["h1", "h2"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    wanted = stored(grouped.mapInPandas(needed, "key long, i int, j int, block int, tree int, h1 long, h2 long, open boolean"), "wanted")

    chosen = wanted.select("h1", "h2").distinct().join(classes.drop("signature"), ["h1", "h2"]).join(members, ["h1", "h2"])
    chosen = stored(chosen.select("h1", "h2", "copies", "keys", "longer", "home", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")), "chosen")
    reps = broadcast_if_small(chosen.select("rid", "rth"))
    texts = rows.join(reps, (rows["id"] == reps["rid"]) & (rows["th"] == reps["rth"])).select("id", "th", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "shingles": [shingle_set(x, hashes, shingle).tobytes() for x in batch["text"]]})

    held = texts.mapInPandas(sets, "id long, th long, shingles binary").dropDuplicates(["id", "th"])
    held = held.join(chosen, (held["id"] == chosen["rid"]) & (held["th"] == chosen["rth"]))
    held = stored(held.select("h1", "h2", "copies", "keys", "longer", "home", "shingles"), "sets")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_cell(batches, lambda cell: linked(cell, *similarity, forest))

    loaded = wanted.join(held, ["h1", "h2"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stored(loaded.mapInPandas(verify, "a1 long, a2 long, b1 long, b2 long, links long, missed array<double>"), "links")


def forest_links(
    rows: DataFrame, classes: DataFrame, forest: Forest, shingle: int, similarity: tuple[int, int], own_recall: float, cell_rows: int
) -> DataFrame:
    """Links of all documents: prefixes of full depth first, shortened for those whose measured recall is under ``own_recall``.

    The links found so far are weighed with the chance that a prefix finds one of their similarity; found over
    found and missed is a document's own recall.
    """
    found = verified_links(rows, classes, *node_cells(classes, forest, forest.depth, None, cell_rows), forest, shingle, similarity)
    open_ = None
    for depth in range(forest.depth, 1, -1):
        lost = found.groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("links").alias("n"), F.sum(F.get("missed", F.lit(depth - 1))).alias("lost"))
        short = lost.where(F.col("n") < own_recall * (F.col("n") + F.col("lost"))).select("h1", "h2")
        open_ = stored(short if open_ is None else short.join(open_, ["h1", "h2"], "left_semi"), "open")
        if open_.isEmpty():
            break
        more = verified_links(rows, classes, *node_cells(classes, forest, depth - 1, open_, cell_rows), forest, shingle, similarity)
        found = found.unionByName(more)
    return found


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (4, 5),
    trees: int = 20,
    most_depth: int = 8,
    recall: float = 0.999,
    own_recall: float = 0.9999,
    cell_rows: int = 256,
) -> DataFrame:
    """Links of ``similarity`` or more between word-shingle sets, and the groups they make.

    Columns: id, th (text hash), class_id (the smallest id that links reach), n_links (other
    documents at that similarity, copies counted), first (whether this id and text
    are the smallest of the group). Words are runs without ASCII blanks, A-Z
    lower-cased; a text of fewer than ``shingle`` words is one shingle. ``similarity`` is a
    fraction, compared in whole numbers. A document's prefixes have the longest length up to ``most_depth``
    at which a pair at the threshold is found with chance ``recall``; where the similarities of its
    links say that its own recall is under ``own_recall``, they are shortened until it isn't.

    A node of more than ``cell_rows`` members is dealt into blocks and each pair of
    blocks is a cell: no node is capped and no task holds more than two
    blocks. Null or empty texts have no links. Null id: largest id. Rows of one id with other
    texts are documents of their own. No rows: no rows. Other columns are ignored.
    """
    numerator, denominator = similarity
    forest = Forest(trees, prefix_depth(trees, most_depth, numerator / denominator, recall))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    drawn = stored(sketches(rows, forest, shingle), "sketches")

    classes = drawn.where("n > 0").groupBy("h1", "h2").agg(
        F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")
    )
    classes = stored(classes, "classes")
    links = forest_links(rows, classes, forest, shingle, similarity, own_recall, cell_rows)

    pair = lambda x: F.struct(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2"))
    counted = links.groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("links").alias("links"))
    labels = components(links.select(pair("a").alias("a"), pair("b").alias("b")))
    labels = labels.select(F.col("c.h1").alias("h1"), F.col("c.h2").alias("h2"), "label")
    grouped = classes.select("h1", "h2", "rep", "copies").join(counted, ["h1", "h2"], "left").join(labels, ["h1", "h2"], "left")
    grouped = grouped.withColumn("label", F.coalesce("label", F.struct("h1", "h2")))
    heads = grouped.groupBy("label").agg(F.min("rep").alias("head"))
    grouped = grouped.join(heads, "label").select(
        "h1", "h2", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = drawn.select("id", "th", "n", "h1", "h2").join(grouped, ["h1", "h2"], "left")
    alone = F.col("head").isNull()
    return out.select(
        "id",
        "th",
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.struct("id", "th") == F.col("head"))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of :func:`jaccard_groups`: that of the smallest id and text hash.

    Of rows with the same id and text one stays too, the first by all its columns as JSON. Texts without words are groups of their own.
    """
    found = stored(jaccard_groups(docs, id_col, text_col, **options).groupBy("id", "th").agg(F.min("first").alias("first"), F.count("*").alias("rows")), "groups")
    repeated = found.where(F.col("first") & (F.col("rows") > 1))
    kept = without(docs, found.where(~F.col("first") | (F.col("rows") > 1)), id_col, text_col)
    ids = broadcast_if_small(repeated.select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), text_hash(docs[text_col]).alias("th"), F.struct(*docs.columns).alias("row")
    )
    rest = rows.join(ids, (rows["id"] == ids["__id"]) & (rows["th"] == ids["__th"]), "left_semi").groupBy("id", "th")
    rest = rest.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.unionByName(rest)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Each document of ``documents`` with its class and its number of links."""
    found = jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c.replace("id", "doc_id") if c == "id" else c)
    return found.select(real("id"), real("class_id"), "n_links")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * met >= 4 * (x.n + y.n - met)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, least(d.doc_id, coalesce(r.least, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
  LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
"""
