"""SimHash near-dedup over a hierarchical index in Gray order.

A document's fingerprint has a bit for each of 64 that is set in over half of its shingles'
XXH64 values. Fingerprints that differ in up to ``radius`` bits are linked; a document's
component is the smallest doc_id that links reach.

The index has three kinds of node, each a pattern that its members share on masked bits:

* The upper nodes factor bits of whole blocks out: the 64 bits fall into blocks, and there is
  a tree for each choice of blocks - radius of them. Fingerprints within the radius agree on
  all of at least one choice, so they share an upper node of its tree at an accumulated
  difference of 0. As many of a choice's bits are factored as leave some NODE fingerprints to
  an upper node; where one block (radius + 1 of them) hasn't that many bits there are more blocks.
  Spark deals fingerprints to upper nodes by (tree, pattern).
* Under an upper node, fingerprints are sorted by Gray rank, which puts codes of few
  differences side by side. Runs of 4 make a leaf, runs of 4 leaves a node above, and so on (16
  for fingerprints of several lanes); each keeps the bits that all its members share.
* The search walks pairs of nodes from the top. A pair's differences on bits that both share
  bound every member pair's from below: beyond the radius the whole pair of groups is pruned.
  So are pairs that lie in one component already, for only components are asked for.

That is exact for any radius that leaves blocks wide enough. For looser similarities the
fingerprints have several 64-bit lanes and there are drawn trees, whose upper nodes share
``factored`` bits drawn for each, chosen from the count likewise: a pair that differs in a share
p of its bits meets with probability 1 - (1 - (1 - p) ** factored) ** trees, so there are as
many trees as bring that to MEET. Below them is the same index with the same exact test.

It yields at most one link for each member of the upper nodes, never all their pairs. Equal
fingerprints are one row before that. Upper nodes of more than HOT fingerprints are split into
tiles that meet pairwise. Nothing is capped.

``similar`` asks for texts instead of fingerprints: the index only finds candidates, by a radius
and trees that let few pairs go, and what it links loosely is compared shingle by shingle. A
Components of more than SETS texts are first searched again by prints of FINER lanes, whose radius ends
where similarities are some 0.69 instead of 0.55, so texts that only resemble each other (templates, chains of
versions) fall apart before any of them is fetched in tiles. A
link is then a Jaccard similarity (of the sets of shingles, as XXH64 values) of at least the
threshold, whatever the fingerprints say, and components are those of such links.

Defined results: a null text is an empty one; without words the fingerprint is zero and is
linked like any other (``similar`` links it to its equals only); with fewer words than a shingle the whole sequence is the one shingle.
Rows whose doc_id is null link nothing and get the component of their fingerprint, or null.
Repeated rows get repeated results. Only the named columns are used, so names can't clash.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, partitions, strings, trimmed, written
from .graph import components, groups, joined_back, merge, tiled

HOT = 20_000
#: A node's children, and the fingerprints that an upper node holds on average at most: of one lane, whose groups are pruned, and of several, where a wide radius prunes little.
FAN, NODE = (4, 16), (4096, 512)
#: The chance to meet in a drawn tree.
MEET = 0.998


#: Lanes of the prints that large loose components are searched with again.
FINER = 16
#: Odd multipliers that make further lanes of a shingle's hash: a fixed sequence (multiples of the golden ratio's fraction).
_ODD = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(FINER + 1)]


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[k])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[k + 1])
    return h ^ (h >> np.uint64(32))


def hashes(text: str, words: int = 4, seed: int = 42) -> list[int]:
    """The hash of each shingle of a whole text: A-Z lower-cased, split at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    f = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [f(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [f(joined[a:b], seed) for a, b in zip(begins[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def shingles(text: str, words: int) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    return np.unique(np.array(hashes(text, words), "<u8"))


def fingerprint(text: str, words: int = 4, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """The fingerprint of a whole text in 64-bit lanes."""
    return majority(hashes(text, words, seed), lanes)


def majority(h: list[int] | np.ndarray, lanes: int) -> np.ndarray:
    """The bits that are set in over half of the hashes, in 64-bit lanes."""
    total = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), 1 << 16):
        own = np.array(h[i : i + (1 << 16)], "<u8")
        for k in range(lanes):
            bits = np.unpackbits(_lane(own, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(h), bitorder="little").view("<u8")


def lane_names(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def fingerprints(df: DataFrame, *, words: int = 4, lanes: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and f0, f1, ...: the fingerprint's lanes as signed longs."""
    bounded_batches(df.sparkSession)
    names = lane_names(lanes)

    def over(it):
        for b in it:
            if b.num_rows:
                f = np.stack([fingerprint(t, words, 42, lanes) for t in strings(b.column(1))]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(lanes))], names=[key, *names])

    return df.select(F.col(key), F.col(text)).mapInArrow(trimmed(over), f"`{key}` {df.schema[key].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The order of codes (rows of lanes) by Gray rank."""
    keys, odd = [], np.zeros(len(codes), bool)
    for k in range(codes.shape[1]):
        keys.append(np.where(odd, ~gray_rank(codes[:, k]), gray_rank(codes[:, k])))
        odd ^= np.bitwise_count(codes[:, k]) % 2 == 1
    return np.lexsort(keys[::-1])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


class Tree:
    """The nodes over codes (rows of lanes) in Gray order: per level the bits that are set in all and in any of a node's members; level 0 are leaves of fan codes."""

    def __init__(self, codes: np.ndarray, fan: int):
        all_ = any_ = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while not self.levels or len(all_) > fan:
            at = np.arange(0, len(all_), fan)
            all_, any_ = np.bitwise_and.reduceat(all_, at, axis=0), np.bitwise_or.reduceat(any_, at, axis=0)
            self.levels.append((all_, any_))

    def apart(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differences that all member pairs of the nodes i and j have."""
        all_, any_ = self.levels[level]
        return _bits((all_[i] & ~any_[j]) | (all_[j] & ~any_[i]))


def join_tree(codes: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the components of codes (distinct rows of lanes, in Gray order) under links of up to radius bits."""
    n, lanes = codes.shape
    fan = FAN[lanes > 1]
    tree, labels = Tree(codes, fan), np.arange(n)
    for d in range(1, min(n, 5)):  # neighbours in Gray order first: most links, cheaply
        i = np.flatnonzero(_bits(codes[d:] ^ codes[:-d]) <= radius)
        merge(labels, i, i + d)
    top = len(tree.levels) - 1
    member = np.minimum(np.arange(len(tree.levels[0][0]) * fan), n - 1).reshape(-1, fan)  # a leaf's codes; the last one's repeat
    leaves = codes[member]
    a, b = np.triu_indices(len(tree.levels[top][0]))
    todo = [(top, a, b)]
    spans: list[tuple[np.ndarray, np.ndarray]] = []

    def refresh():
        del spans[:]
        low = high = labels
        for _ in range(top + 1):
            at = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            spans.append((low, high))

    refresh()
    da, db = np.divmod(np.arange(fan * fan), fan)
    while todo:
        level, i, j = todo.pop()
        most = (1 << 18) // fan**2 if level else (1 << 19) // (fan**2 * lanes)
        if len(i) > most:
            todo += [(level, i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)]
            continue
        low, high = spans[level]
        near = np.minimum(low[i], low[j]) != np.maximum(high[i], high[j])  # else one component already
        near[near] = tree.apart(level, i[near], j[near]) <= radius
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level:
            m = len(tree.levels[level - 1][0])
            x, y = (i[:, None] * fan + da).ravel(), (j[:, None] * fan + db).ravel()
            keep = (x < m) & (y < m) & (x <= y)
            todo.append((level - 1, x[keep], y[keep]))
            continue
        differ = np.zeros((len(i), fan, fan), np.uint16)
        for lane in range(lanes):
            differ += np.bitwise_count(leaves[i, :, None, lane] ^ leaves[j, None, :, lane])
        k, x, y = np.nonzero(differ <= radius)
        x, y = member[i[k], x], member[j[k], y]
        open_ = labels[x] != labels[y]
        if open_.any():
            merge(labels, x[open_], y[open_])
            refresh()
    return labels


def _links(it, radius: int):
    """Links (u, v: node ids) in the upper nodes of a partition sorted by them; columns: upper, lo, hi, node, lanes.

    Upper nodes that are read together are joined to components here, and each of their nodes
    has one link at most: to the least of its component.
    """
    for t in groups(it, 3):
        upper, lo, hi, node, *lanes = (t.column(k).to_numpy() for k in range(t.num_columns))
        edge = np.ones(len(node), bool)
        edge[1:] = (upper[1:] != upper[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(node)))
        codes = np.stack(lanes, axis=1).view(np.uint64)
        labels = np.arange(len(node))  # of rows: those that links join have one
        for b, n in zip(begin[size > 1], size[size > 1], strict=True):
            order = gray_order(codes[b : b + n])
            own = join_tree(codes[b : b + n][order], radius)
            off = np.flatnonzero(own != np.arange(n))
            merge(labels, b + order[off], b + order[own[off]])
        off = np.flatnonzero(labels != np.arange(len(node)))
        nodes, at = np.unique(node, return_inverse=True)
        roots = np.arange(len(nodes))
        merge(roots, at[off], at[labels[off]])
        off = np.flatnonzero(roots != np.arange(len(nodes)))
        if len(off):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[off], pa.int64()), pa.array(nodes[roots[off]], pa.int64())], names=["u", "v"])


def masks(radius: int, blocks: int, factored: int = 64) -> list[int]:
    """The masks of the upper nodes' trees: for each choice of blocks - radius of the blocks, up to factored of their bits, evenly taken."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for c in combinations(range(blocks), blocks - radius):
        bits = [b for i in c for b in range(ends[i], ends[i + 1])]
        at = {bits[len(bits) * k // factored] for k in range(factored)} if factored < len(bits) else bits
        out.append(sum(1 << b for b in at))
    return list(dict.fromkeys(out))


def factored_for(count: int, lanes: int) -> int:
    """Bits to factor out so that upper nodes hold NODE of count fingerprints or fewer on average."""
    return max(0, math.ceil(math.log2(max(count, 1) / NODE[lanes > 1])))


def masks_for(count: int, radius: int) -> list[int]:
    """The masks for so many fingerprints: with as few blocks as have the bits to factor out."""
    factored = factored_for(count, 1)
    blocks = next((b for b in range(radius + 1, radius + 4) if (64 // b) * (b - radius) >= factored), radius + 4)
    return masks(radius, blocks, factored)


def drawn(lanes: int, trees: int, factored: int, seed: int = 5) -> list[list[int]]:
    """For each of the trees, a mask per lane with factored bits in all, drawn from a seed."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        m = [0] * lanes
        for b in r.permutation(64 * lanes)[:factored].tolist():
            m[b // 64] |= 1 << (b % 64)
        out.append(m)
    return out


def differing(similarity: float) -> float:
    """The share of differing bits that texts of a Jaccard similarity of their shingles have."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def drawn_for(count: int, lanes: int, similarity: float) -> list[list[int]]:
    """Drawn trees for so many fingerprints, in which a pair of that similarity meets with probability MEET."""
    factored = factored_for(count, lanes)
    once = (1 - differing(similarity)) ** factored
    return drawn(lanes, math.ceil(math.log(1 - MEET) / math.log(1 - once)) if once < 1 else 1, factored)


def radius_for(similarity: float, lanes: int, deviations: float = 1) -> int:
    """The differing bits that texts of a Jaccard similarity of their shingles have, and so many standard deviations."""
    p, n = differing(similarity), 64 * lanes
    return int(n * p + deviations * math.sqrt(n * p * (1 - p)))


def linked(fps: DataFrame, *, radius: int = 4, similarity: float | None = None, key: str = "doc_id") -> DataFrame:
    """The lanes, component_id and rows (how many) for every distinct fingerprint of fps (key, f0, f1, ...), a written table.

    Exact without a similarity (one lane); with one, pairs of that similarity meet in drawn trees.
    """
    spark = fps.sparkSession
    lanes = [c for c in fps.columns if c != key]
    nodes = written(fps.groupBy(*lanes).agg(F.min(key).alias("node"), F.count("*").alias("rows")), "nodes")
    known = nodes.filter("node is not null")
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    count = known.count()
    trees = drawn_for(count, len(lanes), similarity) if similarity else [[m] for m in masks_for(count, radius)]
    uppers = F.array(*[F.xxhash64(F.lit(k), *[F.col(c).bitwiseAND(signed(x)) for c, x in zip(lanes, m, strict=True) if x]) for k, m in enumerate(trees)])
    rows = known.select(F.explode(uppers).alias("upper"), "node", *lanes)
    rows = tiled(rows, ["upper"], F.col("node"), HOT)
    by = ["upper", "lo", "hi"]
    rows = rows.select(*by, "node", *lanes).repartition(partitions(spark), *by).sortWithinPartitions(*by)
    edges = rows.mapInArrow(trimmed(lambda it: _links(it, radius)), "u long, v long")
    roots = components(edges).withColumnRenamed("node", "at")
    return written(nodes.join(roots, F.col("node") == F.col("at"), "left").select(*lanes, F.coalesce("root", "node").alias("component_id"), "rows"), "linked")


def near_duplicates(df: DataFrame, *, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id for every row."""
    fps = written(fingerprints(df, words=words, key=key, text=text), "fingerprints")
    found = linked(fps, radius=radius, key=key)
    return joined_back(fps, found, ["f0"], "rows").select(key, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def set_prints(df: DataFrame, *, words: int, lanes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, f0, f1, ... (the fingerprint of the set of shingles) and set (a hash of that set)."""
    bounded_batches(df.sparkSession)
    names = lane_names(lanes)

    def over(it):
        for b in it:
            if b.num_rows:
                own = [shingles(t, words) for t in strings(b.column(1))]
                f = np.stack([majority(h, lanes) for h in own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(lanes)), pa.array([_set_hash(h) for h in own], pa.int64())], names=[key, *names, "set"])

    return df.select(F.col(key), F.col(text)).mapInArrow(trimmed(over), f"`{key}` {df.schema[key].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, set long")


def _set_hash(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def join_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels of the components of sets (of distinct values) under links of a Jaccard similarity of at least that much.

    A set is held against the larger ones that its size allows and that lie in other components.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    end = np.cumsum(size)
    begin = end - size
    values, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    labels, mark = np.arange(n), np.zeros(len(values), bool)
    for i in range(n - 1):
        if not size[i]:
            continue
        top = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))
        j = i + 1 + np.flatnonzero(labels[i + 1 : top] != labels[i])
        if not len(j):
            continue
        own = flat[begin[i] : end[i]]
        mark[own] = True
        if len(j) == top - i - 1:
            hit = mark[flat[begin[i + 1] : end[top - 1]]]
        else:
            hit = mark[flat[np.repeat(begin[j] - np.cumsum(size[j]) + size[j], size[j]) + np.arange(size[j].sum())]]
        mark[own] = False
        both = np.add.reduceat(hit, np.cumsum(size[j]) - size[j], dtype=np.int64)
        j = j[both >= similarity * (size[i] + size[j] - both) - 1e-6]
        merge(labels, np.full(len(j), i), j)
    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def _verified(it, similarity: float):
    """Links (u, v: node ids) in the tiles of a partition sorted by them; columns: component_id, lo, hi, node, shingles.

    As in _links, a tile's nodes have one link at most, to one of their component.
    """
    for t in groups(it, 3, 2000):
        *by, node = (t.column(k).to_numpy() for k in range(4))
        sets = t.column(4)
        edge = np.ones(len(node), bool)
        edge[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
        begin = np.append(np.flatnonzero(edge), len(node))
        u, v = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a > 1:
                labels = a + join_sets([np.frombuffer(x, "<u8") for x in sets.slice(a, b - a).to_pylist()], similarity)
                off = np.flatnonzero(labels != np.arange(a, b))
                u.append(node[a + off])
                v.append(node[labels[off]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], names=["u", "v"])


def _finer(asked: DataFrame, df: DataFrame, similarity: float, words: int, key: str, text: str) -> DataFrame:
    """node, set and component_id of the asked nodes, by FINER lanes: what 256 bits chain together at lower similarities falls apart."""
    names = lane_names(FINER)
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = asked.select("node").distinct().hint("merge").join(texts, F.col("node") == F.col("_key")).select("node", "_text")
    prints = set_prints(rows, words=words, lanes=FINER, key="node", text="_text")
    prints = written(prints.join(asked, ["node", "set"], "left_semi").distinct(), "finer")
    found = linked(prints.select("node", *names), radius=radius_for(similarity, FINER, 5), similarity=similarity, key="node")
    return joined_back(prints, found, names, "rows").select("node", "set", "component_id")


def similar(df: DataFrame, *, similarity: float, words: int, lanes: int, radius: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id for every row: the smallest key that links of at least that Jaccard similarity of shingles reach."""
    spark = df.sparkSession
    names = lane_names(lanes)
    fps = written(set_prints(df, words=words, lanes=lanes, key=key, text=text), "fingerprints")
    loose = linked(fps.select(key, *names), radius=radius, similarity=similarity, key=key)
    sets = fps.groupBy(*names, "set").agg(F.min(key).alias("node"), F.count("*").alias("rows")).join(loose.drop("rows"), names)
    sets = written(sets.select(*names, "set", "component_id", F.col("node").cast("long").alias("node"), "rows"), "sets")
    known = sets.filter("node is not null")
    size = written(known.groupBy("component_id").count().filter("count > 1"), "sizes")
    large = size.filter(F.col("count") > SETS).select("component_id")
    if not large.isEmpty():
        again = _finer(known.join(large, "component_id").select("node", "set"), df, similarity, words, key, text)
        sets = written(sets.withColumnRenamed("component_id", "loose").join(again, ["node", "set"], "left").select(*names, "set", F.coalesce("component_id", "loose").alias("component_id"), "node", "rows"), "sets")
        known = sets.filter("node is not null")
        size = known.groupBy("component_id").count().filter("count > 1")
    asked = written(known.select("component_id", "node", "set").join(size.select("component_id"), "component_id"), "asked")
    asked = tiled(asked, ["component_id"], F.xxhash64("node", "set"), SETS)
    by = ["component_id", "lo", "hi"]
    asked = asked.select(*by, "node", "set")
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = asked.hint("merge").join(texts, F.col("node") == F.col("_key")).select(*by, "node", "set", "_text")  # both sides grow with the input: never broadcast

    def sought(it):
        for b in it:
            own = [shingles(t, words) for t in strings(b.column(5))]
            is_it = pa.array([_set_hash(h) == s for h, s in zip(own, b.column(4).to_pylist(), strict=True)], pa.bool_())
            out = [*b.columns[:4], pa.array([h.tobytes() for h in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=[*by, "node", "shingles"]).filter(is_it)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, "node"])
    rows = rows.mapInArrow(trimmed(sought), f"{kinds}, shingles binary")
    rows = rows.repartition(partitions(spark), *by).sortWithinPartitions(*by)
    edges = rows.mapInArrow(trimmed(lambda it: _verified(it, similarity)), "u long, v long")
    roots = components(edges).withColumnRenamed("node", "at")
    labelled = sets.join(roots, F.col("node") == F.col("at"), "left").select(*names, "set", F.coalesce("root", "node").alias("component_id"), "rows")
    return joined_back(fps, written(labelled, "labelled"), [*names, "set"], "rows").select(key, "component_id")


#: Sets of shingles of a loose component that one slab holds.
SETS = 1000
#: Similar texts: five-word shingles of a similarity of 0.8 or more; candidates by 256-bit fingerprints, five standard deviations beyond it.
SIMILAR = {"similarity": 0.8, "words": 5, "lanes": 4, "radius": radius_for(0.8, 4, 5)}


def one_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each component of similar texts: that of the smallest key. Rows without a key stay.

    Where rows share a key they get numbers of their own, in the order of key and text, so rows of one key
    stay apart unless their texts are similar, and of repeated rows one stays.
    """
    id_, row_ = fresh(df.columns, "kept", "row")
    rows = df.filter(F.col(key).isNotNull())
    if rows.groupBy(key).count().filter("count > 1").isEmpty():
        row_ = key
    else:
        rows = rows.repartitionByRange(partitions(df.sparkSession), key, text).sortWithinPartitions(key, text)
        rows = written(rows.withColumn(row_, F.monotonically_increasing_id()), "numbered")
    found = similar(rows, key=row_, text=text, **(how or SIMILAR))
    kept = written(found.filter(F.col(row_) == F.col("component_id")).select(F.col(row_).alias(id_)), "kept")
    out = rows.join(kept.hint("merge"), F.col(row_) == F.col(id_)).select(*df.columns)  # both sides grow with the input: never broadcast
    return out.union(df.filter(F.col(key).isNull()))
