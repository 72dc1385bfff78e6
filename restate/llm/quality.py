"""Quality: document evidence under hierarchical empirical-Bayes priors of host and path.

A logistic classifier over byte shares and surface statistics judges each text by
itself.  Its log-likelihood ratio is the document's evidence.  How good the
documents of a host, and of a path on it, usually are is the prior: each level's
rate is a Beta posterior around the level above,

    rate(host) = (sum + M * rate(all)) / (n + M)
    rate(path) = (sum + K * rate(host)) / (n + K),

with the strengths M and K from the data by the method of moments, so sparse sites
shrink towards the level above and large ones keep their own rate.  All sums are
grouped aggregates over all documents, combined before the shuffle; a document's
own share is left out of its path's rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from restate.llm import textarrays as T
from restate.llm.common import store, text_key

#: Bound of the fit: labelled texts, the first by a hash of their id.
MAX_LABELLED = 20_000
STEPS, RATE, DECAY = 600, 0.05, 1e-3
#: Documents whose posterior is below this are rejected.
MIN_QUALITY = 0.3
#: Bounds of the strengths of priors, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

_SPACE, _NEWLINE = 0x20, 0x0A
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
N_FEATURES = 128 + 12


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float


def _features(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    n = len(data)
    if not n:
        return out
    counts = np.bincount(data, minlength=256)
    out[:128] = np.sqrt(counts[:128] / n)
    letters = counts[_LETTER].sum()
    words = len(hashes)
    lines = int(counts[_NEWLINE]) + 1
    distinct = len(np.unique(hashes)) if words else 0
    doubled = int((hashes[1:] == hashes[:-1]).sum()) if words > 1 else 0
    starts = np.unique(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:]) if words > 3 else ()
    out[128:] = (np.log1p(n) / 10, np.log1p(words) / 10, letters / n, counts[_UPPER].sum() / max(letters, 1), counts[128:].sum() / n,
                 distinct / max(words, 1), doubled / max(words, 1), len(starts) / max(words - 2, 1) if words > 3 else 1.0,
                 np.log1p(letters / max(words, 1)), np.log1p(words / lines), n < 40, words < 8)
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of features per text; null texts are empty, an empty text has none but zeros."""
    out = []
    with np.errstate(over="ignore"):
        for _, rows, data, off in T.byte_chunks(texts):
            h, first = T.words(data, off, T.NOT_SPACE)
            out += [_features(data[off[i]:off[i + 1]], h[first[i]:first[i + 1]]) for i in range(rows)]
    return np.array(out).reshape(-1, N_FEATURES)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression; without both classes it says the share of good texts, 0.5 if there are none."""
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), bias, np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    order = np.lexsort(x.T)  # whatever order rows arrive in
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - centre) / scale, -8, 8)
    w, m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    w[-1] = bias
    for step in range(1, STEPS + 1):
        err = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50))) - y
        grad = np.append(x.T @ err / len(y) + DECAY * w[:-1], err.mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = MAX_LABELLED) -> Model:
    """A model from ``labels`` (id, label; 1 good, 0 bad), of at most ``rows`` of them, and the texts of ``docs``.

    Null ids and labels are ignored; of several labels of an id the least counts.
    The ids, whose number is bounded, are broadcast, so no text is shuffled."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(
        F.min(F.col(label_col)).cast("double").alias("l_label"))
    ids = ids.orderBy(F.xxhash64(F.col("l_id").cast("string")), "l_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    # one text an id, however often it is repeated
    texts = docs.join(F.broadcast(ids), F.col(id_col) == F.col("l_id")).groupBy("l_id", "l_label").agg(F.min(text_col).alias("t"))
    got = texts.select("l_label", "t").mapInArrow(run, "label double, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return train(x, got.column("label").to_numpy())


def evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with llr: how much the text alone speaks for good."""
    at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if i != at]
    logit = float(np.log(model.prior / (1 - model.prior)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip((text_features(batch.column(at)) - model.centre) / model.scale, -8, 8)
            llr = np.clip(x @ model.weights + model.bias - logit, -30, 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(llr)],
                                             names=[*(batch.schema.names[i] for i in keep), "llr"])

    return docs.mapInArrow(run, StructType([docs.schema.fields[i] for i in keep]).add("llr", "double"))


def _strength(total: Column, n: Column, above: Column) -> Column:
    """Method of moments: the strength of a Beta prior with mean ``above`` that explains how far rates stray from it.

    The squared distances of rates from the mean, less what drawing n documents adds, are the variance of the
    true rates; mean * (1 - mean) / variance - 1 is the strength."""
    spread = F.sum(n * F.pow(total / n - above, F.lit(2.0)))
    noise = F.sum(above * (1 - above))
    within = F.sum(n * above * (1 - above))
    between = (spread - noise) / F.greatest(F.sum(n), F.lit(1e-9))
    strength = within / F.greatest(F.sum(n), F.lit(1e-9)) / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(strength, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))


def posterior(rows: DataFrame, prior: float) -> DataFrame:
    """Adds host_rate, path_rate and quality to rows of (host, path, llr, label).

    ``label`` (1 good, 0 bad, null unknown) replaces what the text says in the
    sums.  Null hosts are one host, null paths one path of their host.  ``prior``
    is the share of good texts that llr was measured against.
    """
    logit = F.log(F.lit(prior / (1 - prior)))
    own = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-(F.col("llr") + logit))))
    rows = store(rows.withColumn("own", F.round(own, 6).cast("decimal(20,6)")), "quality-own")  # exact sums: any order gives the same
    paths = rows.groupBy("host", "path").agg(F.sum("own").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    paths = store(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum(F.col("s").cast("decimal(38,6)")).cast("double").alias("s"), F.sum("n").alias("n"))
    rate = hosts.agg((F.sum(F.col("s").cast("decimal(38,6)")).cast("double") / F.sum("n")).alias("r")).first()["r"]
    rate = min(max(rate if rate is not None else prior, 1e-4), 1 - 1e-4)
    m = hosts.agg(_strength(F.col("s"), F.col("n"), F.lit(rate)).alias("m")).first()["m"] or MIN_STRENGTH
    hosts = hosts.select(F.col("host").alias("h_host"), ((F.col("s") + m * rate) / (F.col("n") + m)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    k = paths.agg(_strength(F.col("s"), F.col("n"), F.col("host_rate")).alias("k")).first()["k"] or MIN_STRENGTH
    paths = paths.select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), "s", "n", "host_rate")
    rows = rows.join(paths, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")))
    path_rate = (F.col("s") - F.col("own").cast("double") + k * F.col("host_rate")) / (F.col("n") - 1 + k)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    rows = rows.withColumn("path_rate", path_rate)
    return rows.withColumn("quality", 1 / (1 + F.exp(-(F.col("llr") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))).drop(
        "p_host", "p_path", "s", "n", "own")


def judge(docs: DataFrame, model: Model, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", path_col: str = "lang", label_col: str = "quality", min_quality: float = MIN_QUALITY) -> DataFrame:
    """Per row of ``docs``: id, text_key, host, path, llr, host_rate, path_rate, quality (0 to 1), rejected.

    Null and empty texts are judged by their features, all zero.  Null hosts are
    one host, null paths one path of their host.  Repeated rows and ids each keep
    their row.  An empty table gives no rows; other columns are left out.
    """
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"),
                       F.col(text_col).alias("text"))
    rows = evidence(base, model)
    if labels is None:
        rows = rows.withColumn("label", F.lit(None).cast("double"))
    else:
        known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.min(F.col(label_col)).cast("double").alias("label"))
        rows = rows.join(known, F.col("id") == F.col("l_id"), "left").drop("l_id")
    rows = posterior(rows, model.prior)
    return rows.select("id", "text_key", "host", "path", "llr", "host_rate", "path_rate", "quality", (F.col("quality") < min_quality).alias("rejected"))
