import random
import re

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.components import components

from .corpora import edge_rows, empty, frame, words


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, fp, least.get(find(i))) for i, (d, fp) in enumerate(fps)), key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.groups(df).collect()), key=str)


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        base = words(rng, rng.choice([3, 5, 30, 200, 400])).split()
        rows.append((i * 7 % 101, " ".join(base)))
        for k in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"edit{k}"
            rows.append((200 + i * 5 + k, " ".join(copy).upper() if k % 2 else "\n".join(copy)))
    assert got(spark, rows) == plain_groups(rows)


def test_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert got(spark, rows) == plain_groups(rows)
    assert got(spark, []) == []
    assert simhash.groups(empty(spark)).columns == ["doc_id", "fp", "component_id"]
    assert simhash.groups(frame(spark, edge_rows())).count() == len(edge_rows())


@pytest.mark.parametrize("subtree", [1_000_000, 8])
def test_trie_links_every_near_pair(spark, subtree):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    parts = [base]
    for _ in range(8):  # a family that shares most blocks, and chains
        near = parts[-1].copy()
        for _ in range(4):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
        parts.append(near)
    keys = np.unique(np.concatenate(parts))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    label = {r.u: r.v for r in components(simhash.links(df, 4, subtree)).collect()}
    signed = keys.view(np.int64).tolist()
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    lead = np.arange(len(keys))
    while True:
        new = np.array([lead[near[i]].min() for i in range(len(keys))])
        if (new == lead).all():
            break
        lead = new
    sets = {}
    for k, x in zip(signed, lead.tolist(), strict=True):
        sets.setdefault(x, set()).add(label.get(k, k))
    assert all(len(s) == 1 for s in sets.values())
    assert len({next(iter(s)) for s in sets.values()}) == len(sets)


def test_trie_prunes_by_budget_in_one_task():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 2**20, 3000, dtype=np.uint64) << np.uint64(30))
    root = simhash.trie_sets(keys, 0, 2)
    lead = np.arange(len(keys))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    while True:
        new = np.array([lead[near[i]].min() for i in range(len(keys))])
        if (new == lead).all():
            break
        lead = new
    assert (root == lead).all()


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.u: r.v for r in components(df).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {101: 100}
