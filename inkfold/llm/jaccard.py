"""Near copies: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of SIMILAR or more, and their components.

Equal sets are one node from the start. Nodes whose SimHash fingerprints (of these shingles) the pigeonhole search of simhash.py
links are the first candidates: they are the closest copies, and what they join need not meet below. A node has BANDS keys, each of WIDTH minimum hashes; nodes that share a key and whose
sizes allow the similarity are candidates. A pair at similarity s shares none with chance (1 - s^WIDTH)^BANDS: 3 in a million
at 0.8, less above. Every candidate is verified on its whole sets. In a bucket of many nodes a few pivots meet all others
first; what their links have joined need not meet again, so a group of near copies costs a few rows a member. A bucket that is
still apart goes to one task, which keeps of each set only where it differs from a base, the shingles that most of the bucket's
first nodes have. Two sets are similar if and only if they differ in at most (1 - SIMILAR) / (1 + SIMILAR) of their joint size,
so two that differ from the base by more than that must share differences; prefixes of the rarest ones, with bounds by position,
find all such pairs (_close). Any base gives the same pairs. Far copies of one text mostly differ from it in ways of their own
and are then never compared.

Words are split and A-Z lowered as for fingerprints; shingles are told apart by 64-bit hashes. A text without words has the
empty set's one node; fewer words than a shingle give one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .components import components
from .packed import WordHash, mixed, rolling, trimmed

SHINGLE = 5
SIMILAR = 0.8
BANDS, WIDTH = 32, 5
PIVOTS = 8
#: Nodes of a bucket whose sets make its base.
BASE = 64
_CHUNK = 2_048
_GRID = 1 << 20
_FACTORS = (mixed(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: bytes | None, hashes: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(1, np.uint64)
    return np.unique(rolling(hashes.of(w), min(SHINGLE, len(w))) + np.uint64(min(SHINGLE, len(w))))


def least(found: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set."""
    low, out = (found >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), _CHUNK):
        part = (low[None, at : at + _CHUNK] * _FACTORS[:, None]).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each row of minimum hashes."""
    parts = minima.astype(np.uint64).reshape(-1, BANDS, WIDTH)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(WIDTH):
        key = mixed(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return key


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def print_of(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set: a bit is set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)[0])


def with_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, _ref, node, n (the set's size), fp (its fingerprint), keys of docs(doc_id, _ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(2).cast(pa.binary()).to_pylist()]
            if not sets:
                continue
            keys = band_keys(np.stack([least(s) for s in sets]))
            cols = [b.column(0), b.column(1), pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array([print_of(s) for s in sets], pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_ref", "node", "n", "fp", "keys"])
        trimmed()

    return docs.select("doc_id", "_ref", "text").mapInArrow(run, "doc_id long, _ref string, node long, n int, fp long, keys binary")


def _filed(nodes: DataFrame) -> DataFrame:
    """key, node, root, n: a row for each key of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            node, n = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), BANDS) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(node), pa.array(n)], names=["key", "node", "root", "n"])

    return nodes.select("node", "n", "keys").mapInArrow(run, "key long, node long, root long, n int")


def _met(key: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a, b of the candidates in rows sorted by key, and the places that must meet again."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[new, len(key)])
    apart = np.minimum.reduceat(root, new) != np.maximum.reduceat(root, new)
    a, b, left = [], [], []
    few = apart & (size <= pivots + 1)
    if few.any():
        s = size[few]
        start = np.repeat(new[few], s)
        at = start + np.arange(len(start)) - np.repeat(np.r_[0, np.cumsum(s)[:-1]], s)
        end = start + np.repeat(s, s)
        for d in range(1, int(s.max())):
            i = at[at + d < end]
            a.append(i)
            b.append(i + d)
    for at, s in zip(new[apart & ~few].tolist(), size[apart & ~few].tolist(), strict=True):
        for i in range(at, at + pivots):
            b.append(np.arange(i + 1, at + s))
            a.append(np.full(len(b[-1]), i))
        left.append(np.arange(at + pivots, at + s))
    none = np.zeros(0, np.int64)
    a, b, left = (np.concatenate([none, *x]) for x in (a, b, left))
    able = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b]) - 1e-9)
    return a[able], b[able], left


def _candidates(filed: DataFrame, pivots: int) -> DataFrame:
    """kind 1: candidates node, other; kind 0: rows that must meet again."""

    def told(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, root, n = rows
        if len(key) < 2:
            return
        a, b, left = _met(key, node, root, n, pivots)
        # key, node, other, n, kind
        x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        pair = np.unique(np.stack([x, y], axis=1), axis=0)
        zero = np.zeros(len(pair), np.int64)
        for cols in ((zero, pair[:, 0], pair[:, 1], zero.astype(np.int32), zero.astype(np.int32) + 1), (key[left], node[left], root[left], n[left], np.zeros(len(left), np.int32))):
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["key", "node", "other", "n", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if (cut := np.flatnonzero(rows[0] != rows[0][-1])).size or (kept and kept[-1][0][-1] != rows[0][0]):
                to = int(cut[-1]) + 1 if cut.size else 0
                kept.append([x[:to] for x in rows])
                yield from told([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = []
                rows = [x[to:] for x in rows]  # the last bucket may go on in the next batch
            kept.append(rows)
        if kept:
            yield from told([np.concatenate(x) for x in zip(*kept, strict=True)])

    met = filed.repartition("key").sortWithinPartitions("key", "node")
    return written(met.mapInArrow(run, "key long, node long, other long, n int, kind int"), "near", "kind", batch=100_000)


def _sets(docs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """node, held (its set, packed) of the nodes in asked(_node), each from one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            held = [shingles(t, hashes).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["node", "held"])
        trimmed()

    one = rows.groupBy("node").agg(F.min("_ref").alias("_one")).join(asked.distinct().hint("merge"), F.col("node") == F.col("_node")).select("node", "_one")
    texts = docs.select("_ref", "text").join(written(one, "asked").hint("merge"), F.col("_ref") == F.col("_one")).select("node", "text")
    return written(texts.mapInArrow(run, "node long, held binary"), "sets").dropDuplicates(["node"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("_node")).unionAll(pairs.select("b"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity; the set of a goes to its pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, b = [], []
            for x, y, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = np.frombuffer(held.as_buffer(), np.uint64)
                if y is None:
                    now, own = x, found.copy()
                    continue
                assert x == now
                common = len(np.intersect1d(own, found, assume_unique=True))
                if common >= SIMILAR * (len(own) + len(found) - common) - 1e-9:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trimmed()

    second = pairs.join(sets.hint("merge"), F.col("b") == F.col("node")).select("a", "b", "held")
    first = pairs.select("a").distinct().join(sets.hint("merge"), F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "held")
    met = first.unionAll(second).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return written(met.mapInArrow(run, "a long, b long"), "similar", batch=500)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i] to start[i] + size[i] - 1 of every i, one after another."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))


def _close(root: np.ndarray, n: np.ndarray, diffs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b of links between sets of n shingles, diffs being where each differs from a base: all links between different
    roots, or others that join the same.

    With e = len(diff) - far * n, two sets are similar if they share (e_a + e_b) / 2 differences. So the set of least e is linked
    to all that need share none with it, which are all that need share none with any. Of other pairs, the one of less e shares
    e_b at least, and the two share one among their first len(diff) - (what they must share) + 1, the rarest first.
    """
    far = (1 - SIMILAR) / (1 + SIMILAR)
    size = np.array([len(d) for d in diffs], np.int64)
    order = np.argsort(size - far * n, kind="stable")
    root, n, size = root[order], n[order].astype(np.int64), size[order]
    e = size - far * n
    star = np.flatnonzero(e[1:] <= 1e-6 - e[0]) + 1
    owner, begin = np.repeat(np.arange(len(n)), size), np.r_[0, np.cumsum(size)[:-1]]
    _, which, times = np.unique(np.concatenate([diffs[k] for k in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    value = rank[which]
    value = value[np.lexsort((value, owner))]
    place = np.arange(len(value)) - begin[owner]
    left = size[owner] - place
    shared = value >= int((times == 1).sum())
    head = lambda least: shared & (place < (size - np.ceil(np.maximum(least, 1) - 1e-6).astype(np.int64) + 1)[owner])
    filed, asks = np.flatnonzero(head(e)), np.flatnonzero(head((e + e[0]) / 2))
    filed = filed[np.lexsort((owner[filed], value[filed]))]
    key = value[filed] * len(n) + owner[filed]
    most = np.minimum(owner[asks], np.searchsorted(e, 2 * left[asks] - e[owner[asks]] + 1e-6, "right"))  # of less e, and within what can be shared from here on
    at = np.searchsorted(key, value[asks] * len(n))
    count = np.searchsorted(key, value[asks] * len(n) + most) - at
    asks, at, count = asks[count > 0], at[count > 0], count[count > 0]
    ends, pairs, k = np.cumsum(count), np.zeros(0, np.int64), 0
    while k < len(asks):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _GRID, "right")))
        x, y = np.repeat(asks[k:to], count[k:to]), filed[_places(at[k:to], count[k:to])]
        a, b = owner[x], owner[y]
        able = (root[a] != root[b]) & (2 * np.minimum(left[x], left[y]) >= e[a] + e[b] - 1e-6) & (np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b]) - 1e-9)
        pairs = np.union1d(pairs, a[able] * len(n) + b[able])
        k = to
    a, b = np.divmod(pairs, len(n))
    found = [(np.zeros(len(star), np.int64), star)]
    step = max(1, _GRID // max(1, int(size.max())))
    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        one, two = (np.repeat(np.arange(len(z)), size[z]) * len(times) + value[_places(begin[z], size[z])] for z in (x, y))
        both = np.bincount(np.intersect1d(one, two, assume_unique=True) // len(times), minlength=len(x))
        common = (n[x] + n[y] - (size[x] + size[y] - 2 * both)) / 2
        same = common >= SIMILAR * (n[x] + n[y] - common) - 1e-9
        found.append((x[same], y[same]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    apart = root[a] != root[b]
    return order[a[apart]], order[b[apart]]


def _hot(docs: DataFrame, rows: DataFrame, again: DataFrame) -> DataFrame:
    """Links (a, b) within the buckets of again(key, node, root, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, first, base, diffs = None, [], [], None, []

        def based() -> None:
            nonlocal base
            values, times = np.unique(np.concatenate(first), return_counts=True)
            base = values[2 * times > len(first)]
            diffs.extend(np.setxor1d(x, base, assume_unique=True) for x in first)
            first.clear()

        def told() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                if base is None:
                    based()
                node, root, n = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
                a, b = _close(root, n, diffs)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            for k, node, root, n, held in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if k != key:
                    yield from told()
                    key, nodes, first, base, diffs = k, [], [], None, []
                nodes.append((node, root, n))
                found = np.frombuffer(held.as_buffer(), np.uint64)
                if base is None:
                    first.append(found.copy())
                    if len(first) == BASE:
                        based()
                else:
                    diffs.append(np.setxor1d(found, base, assume_unique=True))
        yield from told()
        trimmed()

    apart = again.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select(F.col("key").alias("_key"))
    hot = written(again.join(apart.hint("merge"), F.col("key") == F.col("_key"), "left_semi"), "hot")
    sets = _sets(docs, rows, hot.select(F.col("node").alias("_node"))).withColumnRenamed("node", "_node")
    met = hot.join(sets.hint("merge"), F.col("node") == F.col("_node")).select("key", "node", "root", "n", "held")
    return written(met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long"), "close", batch=500)


def _joined(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """key, node, root, n of rows, with the roots of tree(node, root)."""
    tree = tree.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    out = rows.drop("root").join(tree.hint("merge"), F.col("node") == F.col("_node"), "left")
    return out.select("key", "node", F.coalesce("_root", "node").alias("root"), "n")


def _further(tree: DataFrame, found: DataFrame) -> DataFrame:
    """The components of tree(node, root) and found(a, b): what is joined stays so."""
    return components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))


def roots(docs: DataFrame, rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of every node but the roots, for docs(_ref, text) and their rows with_nodes; links finds edges (a, b) of
    fingerprints (fp)."""
    nodes = written(rows.groupBy("node").agg(F.first("fp").alias("fp")), "nodes")
    ends = written(nodes.groupBy("fp").agg(F.min("node").alias("end")), "ends")  # one node stands for a fingerprint
    near = links(ends.select("fp"))
    same = nodes.join(ends.hint("merge"), "fp").filter("node <> end").select(F.col("end").alias("a"), F.col("node").alias("b"))
    at = lambda k: ends.select(F.col("fp").alias(f"_{k}"), F.col("end").alias(f"end_{k}")).hint("merge")
    other = near.join(at("a"), F.col("a") == F.col("_a")).join(at("b"), F.col("b") == F.col("_b")).select(F.col("end_a").alias("a"), F.col("end_b").alias("b"))
    pairs = written(same.unionAll(other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    tree = components(_verified(pairs, _sets(docs, rows, _ends(pairs))))
    left = _joined(_filed(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))), tree)
    met = _candidates(left, PIVOTS)
    pairs = written(met.filter("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    tree = _further(tree, _verified(pairs, _sets(docs, rows, _ends(pairs))))
    again = met.filter("kind = 0").select("key", "node", F.col("other").alias("root"), "n")
    if again.isEmpty():
        return tree
    left = written(_joined(again, tree), "left")
    dropped(met)
    return _further(tree, _hot(docs, rows, left))
