"""SimHash near-duplicate groups: fingerprints, and a binary trie joined with itself under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, measured, saved, small_batches
from .components import components

SHINGLE, BUDGET = 4, 4
#: Fingerprints that one subtree may hold before it is split further.
SUBTREE = 1_000_000
#: A fingerprint is frequent from this fraction of all rows on.
HOT = 1000
#: Rows whose subtrees are joined in one go, node pairs held at once, and pairs of leaves compared at once.
ROWS, FRONTIER, LEAF = 1 << 18, 1 << 18, 16


def majority(h: np.ndarray) -> int:
    """The word whose bits are those set in over half of h."""
    n = len(h)
    if n <= 255:
        counts = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(n, 64).sum(axis=0, dtype=np.int64)
    else:
        counts = np.zeros((8, 8), np.int64)
        full = np.zeros(-(-n // 255) * 255, np.uint64)
        full[:n] = h
        full = full.reshape(-1, 255)
        for bit in range(8):  # eight byte-wide counters in each word, none above 255
            part = ((full >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
            counts[:, bit] = part.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        counts = counts.ravel()
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: lower-case ASCII, white-space words, word shingles, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = [digest(whole[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(h, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long. Null texts count as empty."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in byte_texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; root[x] stays the least index of x's set."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def trie_sets(keys: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """For sorted distinct 64-bit keys, the least index linked with each, within subtrees that share depth bits.

    The trie is implicit in the sorted keys: a node is a range of them, its children meet at one bit. Pairs of
    nodes are walked together from each subtree's root, one bit a step; a pair of unlike children costs one of
    the budget, and a pair that has spent more is pruned, as is one whose keys are all in one set already.
    Frontiers are cut into blocks and the deepest block goes first, so memory doesn't grow with the pairs.
    """
    n = len(keys)
    root = np.arange(n)
    if n < 2:
        return root
    top = keys >> np.uint64(64 - depth)
    cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    near = np.flatnonzero((top[1:] == top[:-1]) & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget))
    _unite(root, near, near + 1)
    keep = hi - lo > 1
    stack = [(depth, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), np.int8))]
    changed, steps = True, np.zeros(n, np.int64)
    while stack:
        d, l1, h1, l2, h2, cost = stack.pop()
        if len(l1) > FRONTIER:
            for part in (slice(FRONTIER, None), slice(FRONTIER)):
                stack.append((d, l1[part], h1[part], l2[part], h2[part], cost[part]))
            continue
        if changed:
            steps[1:] = np.cumsum(root[1:] != root[:-1])
            changed = False
        known = (steps[l1] == steps[h1 - 1]) & (steps[l2] == steps[h2 - 1]) & (root[l1] == root[l2])
        live = ~known
        l1, h1, l2, h2, cost = l1[live], h1[live], l2[live], h2[live], cost[live]
        if not len(l1):
            continue
        pairs = (h1 - l1) * (h2 - l2)
        leaf = pairs <= LEAF
        if leaf.any():
            a, b, w, m = l1[leaf], l2[leaf], (h2 - l2)[leaf], pairs[leaf]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            i, j = np.repeat(a, m) + at // np.repeat(w, m), np.repeat(b, m) + at % np.repeat(w, m)
            hit = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if hit.any():
                _unite(root, i[hit], j[hit])
                changed = True
        l1, h1, l2, h2, cost = l1[~leaf], h1[~leaf], l2[~leaf], h2[~leaf], cost[~leaf]
        if not len(l1):
            continue
        bit, shift = np.uint64(1) << np.uint64(63 - d), np.uint64(64 - d)
        m1 = np.searchsorted(keys, ((keys[l1] >> shift) << shift) | bit)
        m2 = np.searchsorted(keys, ((keys[l2] >> shift) << shift) | bit)
        same = l1 == l2
        unlike = np.concatenate([cost + 1, cost[~same] + 1]).astype(np.int8)
        across = (
            np.concatenate([l1, m1[~same]]), np.concatenate([m1, h1[~same]]),
            np.concatenate([m2, l2[~same]]), np.concatenate([h2, m2[~same]]),
        )
        along = (
            np.concatenate([l1, m1]), np.concatenate([m1, h1]),
            np.concatenate([l2, m2]), np.concatenate([m2, h2]),
        )
        for nodes, spent in ((across, unlike), (along, np.concatenate([cost, cost]))):
            a, b, c, e = nodes
            some = (b > a) & (e > c) & (spent <= budget) & ~((a == c) & (b - a < 2))
            if some.any():
                stack.append((d + 1, a[some], b[some], c[some], e[some], spent[some]))
    return root


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 blocks of the bits: words with at most budget differing bits share one."""
    base, more = divmod(bits, budget + 1)
    sizes = [base + (k < more) for k in range(budget + 1)]
    return [(sum(sizes[:k]), s) for k, s in enumerate(sizes)]


def _rotated(fixed: int, start: int) -> F.Column:
    """key with the bits below the fixed ones rotated left by start."""
    width = 64 - fixed
    if not start:
        return F.col("key")
    mask = F.lit((1 << width) - 1) if fixed else F.lit(-1)
    low = F.col("key").bitwiseAND(mask)
    turned = F.shiftleft(low, start).bitwiseOR(F.shiftrightunsigned(low, width - start)).bitwiseAND(mask)
    return turned.bitwiseOR(F.col("key").bitwiseAND(F.lit(~((1 << width) - 1)))) if fixed else turned


def _split(keys: DataFrame, budget: int, depth_of: dict[int, int]) -> DataFrame:
    """Each key once for every block of its free bits, with that block brought to the front of them."""
    made = []
    for t, depth in list(depth_of.items()):
        for k, (start, size) in enumerate(_blocks(64 - depth, budget)):
            sub = t * (budget + 2) + k + 1
            depth_of[sub] = depth + size
            made.append((t, F.struct(F.lit(sub).cast("long").alias("t"), _rotated(depth, start).alias("key"), F.lit(depth + size).alias("depth"))))
        del depth_of[t]
    spread = F.lit(None)
    for t in {t for t, _ in made}:
        spread = F.when(F.col("t") == t, F.array(*[s for u, s in made if u == t])).otherwise(spread)
    return keys.select("fp", F.explode(spread).alias("x")).select("fp", "x.t", "x.key", "x.depth")


def links(distinct: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE, n: int | None = None) -> DataFrame:
    """(u, v): enough links between n distinct fingerprints (fp) to give the components of all pairs within budget.

    Fingerprints that differ in at most budget bits agree in one of budget + 1 blocks, so the trie is laid out
    once for each block, that block's bits first, and only like nodes are paired along it: every subtree below
    is joined with itself in one task. Subtrees of more than subtree keys are split by the same rule in their
    remaining bits until they fit, so no task's memory grows with the data. A task gives a spanning forest of
    its links, not the pairs.
    """
    depth_of = {0: 0}
    todo = distinct.select("fp", F.lit(0).cast("long").alias("t"), F.col("fp").alias("key"), F.lit(0).alias("depth"))
    fit = None
    prefix = F.expr("shiftrightunsigned(key, 64 - depth)")
    while True:
        todo = _split(todo, budget, depth_of).withColumn("g", prefix)
        done = max(depth_of.values()) > 56 or (n is not None and n <= subtree)  # no subtree holds more than all
        if not done:
            large, size = measured(todo.groupBy("t", "g").count().where(F.col("count") > subtree).select("t", "g"), "large")
            done = not size["n"]
        now = todo if done else todo.join(large, ["t", "g"], "left_anti").select(*todo.columns)
        fit = now if fit is None else fit.unionByName(now)
        if done:
            break
        todo = todo.join(large, ["t", "g"], "left_semi").select("fp", "t", "key", "depth")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t, depth, key, fp):
            at = 0
            for cut in [*(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]:
                unsigned = key[at:cut].view(np.uint64)
                order = np.argsort(unsigned)
                root = trie_sets(unsigned[order], int(depth[at]), budget)
                own = fp[at:cut][order]
                far = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[root[far]])], ["u", "v"])
                at = cut

        held: list[tuple[np.ndarray, ...]] = []
        size, enough = 0, ROWS
        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
            size += b.num_rows
            if size >= enough:
                t, g, depth, key, fp = map(np.concatenate, zip(*held, strict=True))
                new = np.flatnonzero((t[1:] != t[:-1]) | (g[1:] != g[:-1])) + 1
                if len(new):
                    c = int(new[-1])
                    yield from solve(t[:c], depth[:c], key[:c], fp[:c])
                    held, size, enough = [tuple(x[c:] for x in (t, g, depth, key, fp))], len(t) - c, ROWS
                else:
                    held, enough = [(t, g, depth, key, fp)], 2 * size
        if size:
            t, _, depth, key, fp = map(np.concatenate, zip(*held, strict=True))
            yield from solve(t, depth, key, fp)

    return (
        fit.select("t", "g", "depth", "key", "fp")
        .repartition("t", "g")
        .sortWithinPartitions("t", "g")
        .mapInArrow(each, "u long, v long")
    )


def groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of at most budget bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id or a text are
    kept, each with its own fingerprint; a null doc_id gets the least id that it reaches. An empty table gives
    no rows. Copies meet in one distinct fingerprint before anything is compared.
    """
    each, rows = measured(fingerprints(docs, shingle), "fingerprints")
    least, size = measured(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    forest = components(links(least.select("fp"), budget, n=size["n"]))
    member = forest.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    member = member.union(forest.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    smallest = member.join(least, "fp").groupBy("root").agg(F.min("least").alias("smallest"))
    linked = member.join(smallest, "root").select("fp", "smallest")
    label = least.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"), "n")
    label = saved(label, "components")
    # Fingerprints of more than a thousandth of all rows are fewer than a thousand: theirs are joined by broadcast.
    hot = F.broadcast(label.where(F.col("n") * HOT > rows["n"]).select("fp", "component_id"))
    often = each.join(hot, "fp").select("doc_id", "fp", "component_id")
    rest = each.join(hot, "fp", "left_anti").join(label, "fp").select("doc_id", "fp", "component_id")
    return often.unionByName(rest)
