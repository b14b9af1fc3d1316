"""SimHash components, collocations and conversation tries against brute force, with hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from claimflow.llm import collocations, prefix_trie, simhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, print string, label string, phrase string, n long"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, radius=2):
    """Smallest index that each one reaches through links."""
    found = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= radius and found[b] < found[a]:
                    found[a], moved = found[b], True
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    near = base.split()
    near[200] = "anders"
    return [
        (7, base), (3, base.upper()), (4, " ".join(near)), (5, None), (6, ""), (8, " \n\t"), (9, "ein"), (10, "Ein"), (11, "zwei worte"),
        (12, "a b c"), (13, "a b c a b c a b c"), (None, base), (None, None), (7, base), (14, "\x1c é x y z"),
        (15, " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))),
    ]


def test_fingerprints_and_components_match_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "de", "a", "b", "c", 1) for i, t in texts], DOCS).repartition(3)
    found = Counter((r["id"], r["print"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.simhash_components(docs).collect())
    order = sorted(texts, key=lambda r: 2**63 - 1 if r[0] is None else r[0])
    ids, prints = [2**63 - 1 if i is None else i for i, _ in order], [plain_print(t) for _, t in order]
    assert found == Counter((i, p, ids[c]) for i, p, c in zip(ids, prints, least_reachable(prints), strict=True))
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {3, 5, 9, 11} and not kept.where("doc_id IN (7, 6, 8)").count()
    assert simhash_dedup.simhash_components(docs.limit(0)).count() == 0


def test_long_text_is_sliced_without_a_change():
    words = [f"w{i % 977}" for i in range(400_000)]
    text = " ".join(words)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], dtype=np.uint64)
    assert simhash_dedup.fingerprint(text) == sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


@pytest.mark.parametrize("radius,most", [(2, 64), (2, 1), (1, 1), (3, 1)])
def test_blocks_lose_no_link(spark, radius, most):
    """Chains of flips, with blocks joined or, where they hold more than ``most``, linked through points between."""
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for p in list(prints):
        for n in range(8):
            p ^= sum(1 << b for b in rng.sample(range(64), 1 + n % (radius + 2)))
            prints.add(p)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash_dedup.near_prints(rows, radius, most).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    at = {p: i for i, p in enumerate(prints)}
    joined = list(range(len(prints)))
    for _ in prints:
        for a, b in links:
            joined[at[a]] = joined[at[b]] = min(joined[at[a]], joined[at[b]])
    assert joined == least_reachable(prints, radius)


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[(lang or "und", tuple(words[i : i + k]))] += 1
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(2 * f[lang, q] >= a for x in (l for l in f if l[0] == lang and len(l[1]) == 3) for q in [x[1]] if f[lang, q] >= least and p in (q[:2], q[1:])):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("sample,most_tokens,filter_words", [(0.3, 1 << 19, 1 << 20), (0.0, 50, 1 << 20), (1.0, 7, 4), (0.5, 3, 1)])
def test_collocations_match_brute_force(spark, monkeypatch, sample, most_tokens, filter_words):
    """Whatever the sample proposes, however texts are cut, and even if the map of proposals is full, counts are exact."""
    rng = random.Random(8)
    pool = ["Alpha", "beta", "gamma", "Ärger", "x\x1cy", "delta"]
    rows = [(rng.choice(["de", "fr", None]), " ".join(rng.choices(pool, [9, 5, 3, 3, 2, 1], k=rng.randrange(60))).replace("delta ", rng.choice(["delta. ", "delta\n", "delta\t "]))) for _ in range(60)]
    rows += [("de", None), (None, ""), ("fr", " .,; \n"), ("en", "a.b"), *[("one", "in the end of it")] * 12, ("two", "a a a a a a a a a a a a a a")]
    docs = spark.createDataFrame([(1, t, g, "a", "b", "c", 5) for g, t in rows], DOCS).repartition(3)
    whole = collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda *a: whole(*a, most_tokens=most_tokens))
    if most_tokens < 100:
        monkeypatch.setattr(collocations, "slices", lambda text: re.findall(r"[^\s]*\s|[^\s]+$", text, re.A) or [""])
    found = {tuple(r) for r in collocations.collocations(docs, sample=sample, filter_words=filter_words).collect()}
    assert found == plain_collocations(rows, 10, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_scores_pass_64_bits(spark, monkeypatch):
    counts = {"a": 3 * 10**12, "b": 2 * 10**12 + 1, "a b": 10**12 + 7}
    words = spark.createDataFrame([("de", 10**13)], "lang string, words long")
    frequent = spark.createDataFrame([("de", p, n) for p, n in counts.items()], "lang string, phrase string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: (frequent, words))
    (row,) = collocations.collocations(frequent).collect()
    assert row["score"] == 1_000_000 * counts["a b"] ** 2 // (counts["a"] * counts["b"]) and row["n"] == 10**13


def plain_trie(seqs):
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids.update(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if seqs[c] == p))).encode()).hexdigest())
        for p, m in members.items()
    )


def by_turn(rows):
    seqs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            seqs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: tuple((r, x) for _, _, r, x in sorted(s)) for c, s in seqs.items()}


TURNS = "conv_id long, turn long, role string, text string, depth string, place string, conv string, weight string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(9)
    rows = []
    for c in [*range(-150, 160, 3), *range(200, 230)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["ja", "nein", "Größe 𝄞", "", None])))
    rows += [(100, t, "user", "lang") for t in range(200)] + [(170, t, "user", "lang") for t in range(200)] + [(171, t, "user", f"{t}") for t in range(150)]
    rows += [(c, t, "a", "gleich") for c in range(300, 330) for t in range(40)] + [(c, t, "a", "länger") for c in range(400, 430) for t in range(c - 399)]
    rows += [(500, 0, "user", "doppelt"), (500, 0, "user", "doppelt"), (None, 0, "user", "ohne")]
    return [(*r, "a", "b", "c", "d") for r in rows]


@pytest.mark.parametrize("most_turns", [4096, 6])
def test_conversation_trie_matches_brute_force(spark, turns, monkeypatch, most_turns):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = spark.createDataFrame(turns, TURNS).repartition(3)
    found = Counter(tuple(r) for r in prefix_trie.conversation_trie(rows, most_turns=most_turns).collect())
    assert found == plain_trie(by_turn(turns))
    assert prefix_trie.conversation_trie(rows.limit(0)).count() == 0


def test_forked_conversations_match_brute_force(spark, turns):
    rows = spark.createDataFrame(turns, TURNS).repartition(3)
    ordered = prefix_trie.stored(prefix_trie.ordered_turns(rows, "conv_id", "turn", "role", "text"), "ordered")
    sequences, convs = prefix_trie.forked(ordered, 100, 5)
    found = Counter(tuple(r) for r in prefix_trie.trie_nodes(sequences, convs, 50).collect())
    own = by_turn(turns)
    rebuilt = {}
    for c, s in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, ())[:h] + s[h:]
    assert found == plain_trie(rebuilt)
