"""Quality classifier by hierarchical empirical Bayes.

Two targets, `quality` and `toxic`, are scored for every document. The document's own evidence comes from a logistic
regression with an L1 penalty over distinct lower-case words, their first 4 to 6 bytes and binned shape measures, fitted to
the labels of documents at hand, first in the order of a hash of their id, MAX_FIT at most; the evidence is its log-odds less the
log-odds of the sample's base rate. The prior odds come from the document's site: labelled positives are summed by host
(`source`) and by path within the host (`lang` where no finer path is given) over all labels, the host's rate is shrunk toward
the global rate and the path's toward its host's, each with the strength that the spread of the rates shows (method of
moments). Sparse or unlabelled sites so fall back to their host or to the global prior. Posterior log-odds are the evidence
plus the prior's log-odds.

Only the sample's texts, MAX_FIT rows and MAX_FIT_BYTES whatever the corpus (the rows from the first on that fit in), and single
sums reach the driver. The weights sent to the workers
are those of features in that sample.

Defined results: null text has no words; null hosts and paths are sites of their own; a label whose document is missing is
ignored; several labels of one document count once each; a target that the labels don't show both ways has evidence 0, and
without any label its prior is 0.5 for quality and the document is kept. Repeated rows get a row each. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, written

#: Labelled documents that the classifier is fitted to, at most.
MAX_FIT = 4_000
#: And bytes of their texts, at most.
MAX_FIT_BYTES = 64_000_000
MIN_HELD = 3
PENALTY = 1e-3
STEPS = 150
RATE = 0.5
#: Bounds of a prior's strength, in labelled documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1_000.0
MAX_TOXIC, MIN_QUALITY = 0.5, 0.5
TARGETS = ("quality", "toxic")
PREFIXES = (4, 5, 6)
#: Priors without any label.
EMPTY = {"quality": 0.5, "toxic": 0.01}
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!"


def _bin(x: float) -> int:
    return min(int(x * 20), 20)


def features(text: bytes | None) -> set[bytes]:
    """The distinct features of a text."""
    text = text or b""
    words = text.lower().split()
    n, size = len(words), max(len(text), 1)
    out = set(words)
    distinct = len(out)
    heads = {b"%d:%b" % (k, w[:k]) for k in PREFIXES for w in {w[:k] for w in out}}
    out |= heads
    out.add(b"\x00upper%d" % _bin(1 - len(text.translate(None, _UPPER)) / size))
    out.add(b"\x00symbol%d" % _bin(1 - len(text.translate(None, _SYMBOLS)) / size))
    out.add(b"\x00again%d" % _bin(1 - distinct / max(n, 1)))
    out.add(b"\x00pairs%d" % _bin(1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)))
    out.add(b"\x00words%d" % n.bit_length())
    return out


def _fitted(rows: np.ndarray, cols: np.ndarray, n: int, width: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept less the base rate's log-odds, by proximal steps scaled to each weight's gradients."""
    base = float(np.log(y.mean() / (1 - y.mean())))
    w, b, seen = np.zeros(width), base, np.full(width, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        gw = np.bincount(cols, weights=g[rows], minlength=width)
        seen += gw * gw
        step = RATE / np.sqrt(seen)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        b -= 2 * RATE * g.sum()
    return w, b - base


def fit(sample: list[tuple[bytes | None, dict[str, int]]]) -> tuple[dict[bytes, tuple[float, float]], list[float]]:
    """Feature -> weight for each target, and the intercepts, of (text, labels) rows."""
    ids: dict[bytes, int] = {}
    found = [[ids.setdefault(f, len(ids)) for f in sorted(features(t))] for t, _ in sample]
    cols = np.array([c for f in found for c in f], np.int64)
    rows = np.repeat(np.arange(len(sample)), [len(f) for f in found])
    use = np.bincount(cols, minlength=max(len(ids), 1)) >= MIN_HELD
    rows, cols = rows[use[cols]], cols[use[cols]]
    weights, intercepts = np.zeros((max(len(ids), 1), len(TARGETS))), [0.0] * len(TARGETS)
    for k, t in enumerate(TARGETS):
        y = np.array([x.get(t) if x.get(t) is not None else np.nan for _, x in sample], float)
        known = np.flatnonzero(~np.isnan(y))
        if len(known) and 0 < y[known].mean() < 1:
            at = np.full(len(sample), -1)
            at[known] = np.arange(len(known))
            has = at[rows] >= 0
            weights[:, k], intercepts[k] = _fitted(at[rows[has]], cols[has], len(known), len(weights), y[known])
    live = {f: tuple(weights[i]) for f, i in ids.items() if weights[i].any()}
    return live, intercepts


def _sampled(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes | None, dict[str, int]]]:
    order = [F.xxhash64("_l"), F.col("_l"), *[F.col(t) for t in TARGETS]]
    usable = labels.select(F.col("doc_id").cast("long").alias("_l"), *TARGETS).join(docs.select(F.col("doc_id").cast("long").alias("_d")), F.col("_l") == F.col("_d"), "left_semi")
    chosen = written(usable.orderBy(*order).limit(MAX_FIT), "sample")
    got = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("binary").alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_l"))  # MAX_FIT rows
    place = [*order, F.xxhash64("_t")]
    got = written(got.withColumn("_size", F.coalesce(F.octet_length("_t"), F.lit(0))).orderBy(*place).limit(MAX_FIT), "sample-texts")
    sizes = np.cumsum([r["_size"] for r in got.orderBy(*place).select("_size").collect()])
    kept = got.orderBy(*place).limit(int(np.searchsorted(sizes, MAX_FIT_BYTES, "right"))).collect()
    return [(None if r["_t"] is None else bytes(r["_t"]), {t: r[t] for t in TARGETS}) for r in kept]


def scored(docs: DataFrame, weights: dict[bytes, tuple[float, float]], intercepts: list[float], host: str, path: str) -> DataFrame:
    """doc_id, host, path, evidence_<target> of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # features of at most MAX_FIT documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value
        names = live.keys()
        for b in batches:
            out = np.tile(np.array(intercepts, float), (b.num_rows, 1))
            for i, t in enumerate(b.column(3).cast(pa.binary()).to_pylist()):
                for f in sorted(names & features(t)):
                    out[i] += live[f]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(out[:, k]) for k in range(len(TARGETS))]], names=["doc_id", "host", "path", *[f"evidence_{t}" for t in TARGETS]])

    src = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string"), F.col(path).cast("string"), "text")
    return src.mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"evidence_{t} double" for t in TARGETS))


def _strength(m, v):
    return F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX))).otherwise(F.lit(PRIOR_MAX))


def site_priors(train: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """paths(host, path, prior_*), hosts(host, prior_*) and the global priors by target."""
    paths = written(
        train.groupBy("host", "path").agg(*[x for t in TARGETS for x in (F.count(t).alias(f"n_{t}"), F.sum(F.when(F.col(t) == 1, 1).otherwise(0)).alias(f"p_{t}"))]), "sites"
    )
    hosts = paths.groupBy("host").agg(*[F.sum(f"{x}_{t}").alias(f"{x}_{t}") for t in TARGETS for x in "np"])

    def spread(table: DataFrame) -> dict:
        row = table.agg(
            *[x for t in TARGETS for x in (F.sum(f"p_{t}").alias(f"p_{t}"), F.sum(f"n_{t}").alias(f"n_{t}"), F.var_pop(F.when(F.col(f"n_{t}") > 0, F.col(f"p_{t}") / F.col(f"n_{t}"))).alias(f"v_{t}"))]
        ).first()
        return {t: ((row[f"p_{t}"] or 0) / row[f"n_{t}"] if row[f"n_{t}"] else EMPTY[t], row[f"v_{t}"] or 0.0) for t in TARGETS}

    top, low = spread(hosts), spread(paths)
    rate = lambda t, m, k: (F.col(f"p_{t}") + m * k) / (F.col(f"n_{t}") + k)
    hosts = hosts.select("host", *[rate(t, F.lit(top[t][0]), _strength(F.lit(top[t][0]), F.lit(top[t][1]))).alias(f"host_{t}") for t in TARGETS])
    hosts = written(hosts, "host-priors")
    paths = join_small(paths, hosts, "host", F.col("path"))
    paths = paths.select("host", "path", *[rate(t, F.col(f"host_{t}"), _strength(F.lit(low[t][0]), F.lit(low[t][1]))).alias(f"path_{t}") for t in TARGETS])
    return written(paths, "path-priors"), hosts, {t: top[t][0] for t in TARGETS}


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence_<target>, prior_<target>, p_<target>, is_toxic, kept: a row a document."""
    rows = written(scored(docs, *fit(_sampled(docs, labels)), host, path), "evidence")
    train = rows.join(labels.select(F.col("doc_id").cast("long").alias("_l"), *TARGETS), F.col("doc_id") == F.col("_l")).select("host", "path", *TARGETS)
    paths, hosts, top = site_priors(train)
    site = lambda d: d.withColumn("_site", F.struct(F.col("host").alias("h"), F.col("path").alias("p")))
    out = join_small(site(rows), site(paths).drop("host", "path"), "_site", F.col("doc_id"))
    out = join_small(out.drop("_site"), hosts, "host", F.col("doc_id"))
    for t in TARGETS:
        prior = F.coalesce(F.col(f"path_{t}"), F.col(f"host_{t}"), F.lit(float(top[t])))
        out = out.withColumn(f"prior_{t}", F.least(F.greatest(prior, F.lit(1e-4)), F.lit(1 - 1e-4)))
        odds = F.col(f"evidence_{t}") + F.log(F.col(f"prior_{t}") / (1 - F.col(f"prior_{t}")))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0)))))
    toxic = F.col("p_toxic") > MAX_TOXIC
    return out.select("doc_id", *[f"{x}_{t}" for x in ("evidence", "prior", "p") for t in TARGETS], toxic.alias("is_toxic"), (~toxic & (F.col("p_quality") >= MIN_QUALITY)).alias("kept"))
