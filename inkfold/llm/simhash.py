"""SimHash near-duplicates: fingerprints, a generalised-pigeonhole search over all of them, and their components.

A fingerprint bit is set when over half of the XXH64 values of a text's word shingles have it. Equal fingerprints are one
node from the start, so copies cost nothing further. Links (at most MAX_BITS differing bits) between different fingerprints
are found by pigeonhole: the 64 bits are dealt into m partitions, correlated bits together, and partition i gets a threshold
t_i with sum(t_i) = MAX_BITS - m + 1, so two linked fingerprints differ in at most t_i bits of some partition i. m and the
thresholds are the cheapest by dynamic programming over probes plus estimated candidates; the estimate is a beta-binomial
fitted to the mean and variance of the distance within a partition, which follow from counts of bit pairs over all
fingerprints. Any choice finds every link: the estimate decides cost only. A fingerprint is filed under its partition values
and probes the values up to t_i bits away; rows that meet are verified on all 64 bits. Buckets of over HOT_BUCKET rows, counted
first, are dealt again by the other bits. Whatever meets in one task is reduced
to a spanning forest before it leaves, so a group of many near copies gives a row a member, not a row a pair.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words than a
shingle give one shingle; component_id is the smallest doc_id reachable, null only if every doc_id in the component is null;
repeated rows keep a row each. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import join_small, written
from .components import components
from .packed import trimmed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MAX_PARTS = 4
#: Cost of a verified candidate, a probe being 1.
CANDIDATE_COST = 0.5
#: Rows of a bucket up to which all pairs are compared at once; larger buckets are searched from row to row.
SMALL_BUCKET = 48
#: Rows of a bucket up to which one task searches it.
HOT_BUCKET = 500_000
_PIECE = 1 << 16


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    w = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _PIECE):
        part = h[at : at + _PIECE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str = "_fp") -> DataFrame:
    """docs with a long column, the fingerprint of `text`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, name])
        trimmed()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)]))


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), _PIECE):
                bits = np.unpackbits(np.ascontiguousarray(fp[at : at + _PIECE]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["i", "c"])

    got = {r.i: r.c for r in nodes.select("fp").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}  # 4,097 rows
    return got.get(4096, 0), np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def grouped(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    rho = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(rho, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [max(left, key=lambda b: (rho[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (rho[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def within(n: int, together: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated chance, for each t up to most, that two fingerprints differ in at most t of the bits."""
    p = np.diag(together) / max(n, 1)
    sign = 1 - 2 * p
    both = 1 - 2 * p[:, None] - 2 * p[None, :] + 4 * together / max(n, 1)  # mean of the product of two signs
    s = sign[bits]
    w, mean = len(bits), ((1 - s**2) / 2).sum()
    cov = (both[np.ix_(bits, bits)] ** 2 - np.outer(s**2, s**2)) / 4
    np.fill_diagonal(cov, (1 - s**4) / 4)
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    var = cov.sum()
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = [math.comb(w, d) * math.exp(beta(d + a, w - d + b) - beta(a, b)) for d in range(min(most, w) + 1)]
    return list(np.cumsum(pmf))


def plan(n: int, together: np.ndarray, bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe; thresholds below zero are left out."""
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, min(MAX_PARTS, bits + 1) + 1):
        groups = grouped(n, together, m)
        states: dict[int, tuple[float, list]] = {0: (0.0, [])}  # used budget, each threshold counted as t + 1 -> cheapest
        for g in groups:
            near, nxt = within(n, together, g, bits), {}
            for used, (cost, chosen) in states.items():
                for t in range(-1, bits - used + 1):
                    if (u := used + t + 1) <= bits + 1:
                        more = 0.0 if t < 0 else n * (1 + sum(math.comb(len(g), d) for d in range(t + 1))) + CANDIDATE_COST * n * n / 2 * near[min(t, len(near) - 1)]
                        if u not in nxt or cost + more < nxt[u][0]:
                            nxt[u] = (cost + more, [*chosen, (g, t)])
            states = nxt
        if bits + 1 in states and states[bits + 1][0] < best[0]:
            best = states[bits + 1]
    return [(g, t) for g, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, own (filed or probing), fp: what meets in a bucket."""
    out = None
    for k, (bits, t) in enumerate(parts):
        flips = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        rows = nodes.select(
            F.lit(k).alias("part"), key.alias("key"), "fp", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip")
        ).select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"), "fp")
        out = rows if out is None else out.unionAll(rows)
    return out


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (x := find(x)) != (y := find(y)):
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _pairs(fp: np.ndarray, new: np.ndarray, size: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links within runs of SMALL_BUCKET rows or fewer."""
    pairs = []
    if len(size):
        first = np.repeat(new - np.r_[0, np.cumsum(size)[:-1]], size)
        rows = first + np.arange(size.sum())
        left = np.repeat(new + size, size) - rows - 1
        for d in range(1, int(size.max())):
            a = rows[left >= d]
            near = np.bitwise_count(fp[a] ^ fp[a + d]) <= bits
            if near.any():
                pairs.append((fp[a[near]].view(np.int64), fp[a[near] + d].view(np.int64)))
    return pairs


def _tree(rest: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a search tree over distinct fingerprints."""
    pairs = []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                pairs.append((np.repeat(x, len(found)).view(np.int64), found.view(np.int64)))
                front.extend(found)
    return pairs


def _links(new: np.ndarray, own: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links within the buckets, which begin at `new`; of a large bucket only those that keep its components.

    A large bucket is dealt by each of bits + 1 equal slices of the 64 bits in turn: two linked rows are equal in one of them.
    """
    size = np.diff(np.r_[new, len(fp)])
    live = (size > 1) & (np.add.reduceat(own.astype(np.int64), new) > 0)
    fp = fp.view(np.uint64)
    little = live & (size <= SMALL_BUCKET)
    pairs = _pairs(fp, new[little], size[little], bits)
    edges = [64 * k // (bits + 1) for k in range(bits + 2)]
    for at, n in zip(new[live & ~little].tolist(), size[live & ~little].tolist(), strict=True):
        every = np.unique(fp[at : at + n])
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = every >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
            order = np.argsort(part, kind="stable")
            part, dealt = part[order], every[order]
            runs = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            long = np.diff(np.r_[runs, len(part)])
            few = long <= SMALL_BUCKET
            pairs += _pairs(dealt, runs[few & (long > 1)], long[few & (long > 1)], bits)
            for s, m in zip(runs[~few].tolist(), long[~few].tolist(), strict=True):
                pairs += _tree(dealt[s : s + m], bits)
    return pairs


def _spread(filed: DataFrame, parts: list[tuple[list[int], int]], bits: int) -> DataFrame:
    """filed with its buckets of over HOT_BUCKET rows dealt anew, by each of bits + 1 groups of the bits outside their part.

    Rows linked within a bucket are equal in its part and differ in `bits` others at most, so in one group they are equal.
    """
    hot = written(filed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_BUCKET).select(F.struct("part", "key").alias("at"), F.lit(True).alias("hot")), "hot-buckets")
    filed = filed.withColumn("at", F.struct("part", "key"))
    rows = join_small(filed, hot, "at", F.col("fp")).drop("at")
    groups = []
    for k, (own, _) in enumerate(parts):
        rest = [b for b in range(64) if b not in own]
        masks = [sum(1 << b for b in rest[g :: bits + 1]) for g in range(bits + 1)]
        groups.append((k, F.array(*[F.struct(F.lit(g).alias("group"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for g, m in enumerate(masks)])))
    cold = F.array(F.struct(F.lit(-1).alias("group"), F.lit(0).cast("long").alias("value")))
    dealt = F.when(F.col("hot").isNull(), cold)
    for k, made in groups:
        dealt = dealt.when(F.col("part") == k, made)
    return rows.withColumn("_g", F.explode(dealt)).select("part", "key", "_g.group", "_g.value", "own", "fp")


def links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between different fingerprints whose components are those of all links of at most `bits` bits."""
    n, together = bit_counts(nodes)
    parts = plan(n, together, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]) > 1:
                new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)])
                a, b = _forest(_links(new, *rows[4:], bits))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            if len(rows[0]):
                cut = np.flatnonzero(np.any([x != x[-1] for x in rows[:4]], axis=0))
                cut = cut[-1] + 1 if len(cut) else 0  # the last bucket may go on in the next batch
                yield from told([x[:cut] for x in rows])
                rows = [x[cut:] for x in rows]
            kept = rows
        if kept is not None:
            yield from told(kept)

    if not parts:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    bucket = ["part", "key", "group", "value"]
    met = _spread(_filed(nodes, parts), parts, bits).repartition(*bucket).sortWithinPartitions(*bucket)
    return met.mapInArrow(run, "a long, b long")


def classes(nodes: DataFrame) -> DataFrame:
    """fp, component_id, keeper for nodes(fp, first, keeper): the smallest doc_id and keeper of the component."""
    nodes = written(nodes, "fingerprints")
    roots = components(links(nodes))
    joined = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "keeper"), "rooted")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.min("keeper").alias("_keeper"))
    return written(joined.join(least, "root").select("fp", "component_id", F.col("_keeper").alias("keeper")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: a row a document."""
    rows = written(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "_fp"), "prints")
    found = classes(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first"), F.min("doc_id").alias("keeper")))
    return rows.join(found, rows["_fp"] == found["fp"]).select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, less all but one of each component of near copies: the first by doc_id, nulls last.

    Near copies have five-word shingles at Jaccard 0.8 or more (jaccard.py), not the digest's three words and bits. SimHash links
    of fingerprints over these shingles join the closest copies, each link verified on its sets; minimum hashes find the others.
    Rows equal in doc_id and text are one document, of which the row with the least hash of its other columns is kept. Joins of
    texts are sort-merge joins whatever the size, with the keys of those that stay or are compared; the key has 128 bits.
    """
    ref = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    slim = docs.select(F.col("doc_id").cast("long"), ref.alias("_ref"), "text")
    rows = written(jaccard.with_nodes(slim), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_ref").alias("r"))
    tree = jaccard.roots(slim, rows, links).withColumnRenamed("node", "_node")
    nodes = rows.groupBy("node").agg(F.min(first).alias("keeper"))
    rooted = nodes.join(tree.hint("merge"), F.col("node") == F.col("_node"), "left").select(F.coalesce("root", "node").alias("root"), "keeper")
    kept = written(rooted.groupBy("root").agg(F.min("keeper").alias("keeper")).select(F.col("keeper.r").alias("_kept")).distinct(), "kept")
    others = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    whole = docs.select(F.struct("*").alias("_doc"), ref.alias("_ref"), others.alias("_others"))
    stay = whole.join(kept.hint("merge"), F.col("_ref") == F.col("_kept"), "left_semi")
    return stay.groupBy("_ref").agg(F.min_by("_doc", "_others").alias("_doc")).select("_doc.*")
