"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the whole text is encoded as counts and ratios
of its bytes and words; a dense layer makes its representation; gated attention weighs the passages; the weighted
representation gives the score. Training sees document labels only.

Training rows: at most ``max_train`` labelled documents of the training folds, those with the smallest hashes of their id; the
rest of the corpus is scored whole. Features of the training bags are made on the executors; the driver gets only them.

Defined results: a null or empty text is one passage of zeros, and is scored; ties can't occur between documents (each is
scored alone); equal texts get equal scores; an empty table stays empty; without any label of each class every score is the
share of label 1 (0.5 without labels). Extra columns are kept by ``classify``, whatever their names, but for its own two.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_groups

PASSAGE_WORDS = 64
#: Byte classes: white space, lower, upper, digit, "!", other ASCII marks by two groups, bytes past ASCII, controls.
_CLASSES = np.full(256, 8, np.int64)
for _i, _set in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"!", b"#$%&*<>|=@^~\\{}", b".,;:?'\"-()[]/+_`")):
    _CLASSES[list(_set)] = _i
_CLASSES[128:] = 7
N_FEATURES = 15


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(d) for d in data])
    doc_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    kind = _CLASSES[flat]
    space = kind == 0
    begins = ~space & np.concatenate(([True], space[:-1]))
    ordinal = np.cumsum(begins)  # words so far, this byte's included
    first = ordinal[doc_start] - begins[doc_start]
    n_words = np.add.reduceat(begins.astype(np.int64), doc_start)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    pass_start = np.concatenate(([0], np.cumsum(n_pass)[:-1]))
    doc = np.repeat(np.arange(len(data)), lengths)
    passage = pass_start[doc] + np.maximum(ordinal - first[doc] - 1, 0) // PASSAGE_WORDS
    total = int(n_pass.sum())
    counts = np.bincount(passage * 9 + kind, minlength=total * 9).reshape(total, 9).astype(np.float64)
    newlines = np.bincount(passage[flat == 10], minlength=total)
    at = np.flatnonzero(begins)
    word_passage = passage[at]
    words = np.bincount(word_passage, minlength=total)
    # A word's hash: its bytes weighted by place, spaces counting nothing.
    if len(at):
        place = np.arange(len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat)))) if at[0] == 0 else np.concatenate((np.zeros(at[0], np.int64), np.arange(at[0], len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat))))))
        with np.errstate(over="ignore"):
            weight = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9)) ** np.uint64(3)
            hashes = np.add.reduceat(np.where(space, np.uint64(0), (flat.astype(np.uint64) + np.uint64(1)) * weight), at)
        order = np.lexsort((hashes, word_passage))
        fresh = np.concatenate(([True], (np.diff(word_passage[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])))
        distinct = np.bincount(word_passage[order][fresh], minlength=total)
        twin = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (np.diff(word_passage) == 0)))
        twins = np.bincount(word_passage[twin], minlength=total)
    else:
        distinct = twins = np.zeros(total)
    chars = np.maximum(1, counts[:, 1:].sum(1))
    w = np.maximum(1, words)
    return np.column_stack([counts[:, 1:] / chars[:, None], chars / w / 10, distinct / w, twins / w, newlines / w, np.log1p(words) / 5, counts[:, 5] / w, counts[:, 4] / w]).astype(np.float32), n_pass


class Mil(NamedTuple):
    """Parameters; ``base`` is used alone where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray
    base: float | None = None


def _forward(p: Mil, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    z = (x - p.mean) / p.scale
    h = np.tanh(z @ p.w1 + p.b1)
    t, g = np.tanh(h @ p.v), 1 / (1 + np.exp(-(h @ p.u)))
    e = (t * g) @ p.a
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    weight = e / np.repeat(np.add.reduceat(e, starts), counts)
    m = np.add.reduceat(weight[:, None] * h, starts)
    return z, h, t, g, weight, m, 1 / (1 + np.exp(-(m @ p.c + p.d)))


def scores(p: Mil, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if p.base is not None:
        return np.full(len(counts), p.base)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    return _forward(p, x.astype(np.float64), starts, counts)[-1]


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 16, gates: int = 8, steps: int = 300, rate: float = 0.03, seed: int = 5) -> Mil:
    """Adam on the log loss of whole bags; gradients by hand."""
    none = np.zeros(1)
    if len(y) == 0 or y.min() == y.max():
        return Mil(*[none] * 9, base=float(y.mean()) if len(y) else 0.5)
    r = np.random.default_rng(seed)
    x = x.astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    p = Mil(x.mean(0), x.std(0) + 1e-3, r.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 0.3, (hidden, gates)), r.normal(0, 0.3, (hidden, gates)), r.normal(0, 0.3, gates), r.normal(0, 0.3, hidden), np.zeros(1))
    names = ("w1", "b1", "v", "u", "a", "c", "d")
    m1, m2 = ({n: np.zeros_like(getattr(p, n)) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        z, h, t, g, weight, m, s = _forward(p, x, starts, counts)
        ds = (s - y) / len(y)
        dm = np.repeat(ds[:, None] * p.c, counts, axis=0)
        dweight = (dm * h).sum(1)
        de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, starts), counts))
        dt, dg = de[:, None] * p.a * g * (1 - t * t), de[:, None] * p.a * t * g * (1 - g)
        dh = (weight[:, None] * dm + dt @ p.v.T + dg @ p.u.T) * (1 - h * h)
        grad = {"w1": z.T @ dh + 1e-4 * p.w1, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": m.T @ ds + 1e-4 * p.c, "d": np.array([ds.sum()])}
        new = {}
        for n in names:
            m1[n] = 0.9 * m1[n] + 0.1 * grad[n]
            m2[n] = 0.999 * m2[n] + 0.001 * grad[n] ** 2
            new[n] = getattr(p, n) - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
        p = p._replace(**new)
    return p


def _groups(texts: list[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    return text_groups(texts, limit)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 3000) -> Mil:
    """``labels`` must hold training rows only; of them at most ``max_train`` are used."""
    known = labels.select(labels[key].alias("__k"), labels[label].cast("double").alias("__y")).where("__k IS NOT NULL AND __y IS NOT NULL").distinct()
    sample = known.orderBy(F.xxhash64("__k"), "__k", "__y").limit(max_train)
    bags = docs.select(docs[key].alias("__k"), docs[text].alias("__t")).join(F.broadcast(sample), "__k")  # at most ``max_train`` rows

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, feats = batch.column("__t").to_pylist(), []
            for a, b in _groups(texts):
                x, n = encode(texts[a:b])
                ends = np.cumsum(n)
                feats += [x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
            yield pa.record_batch([batch.column("__k").cast(pa.string()), batch.column("__y"), pa.array(feats, pa.binary())], ["k", "y", "x"])

    rows = bags.mapInArrow(run, "k string, y double, x binary").toPandas().sort_values(["k", "y"])
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in rows["x"]]
    return fit(np.concatenate(x) if x else np.zeros((0, N_FEATURES)), np.array([len(b) for b in x], np.int64), rows["y"].to_numpy(float))


def _scored(model: Mil, texts: list[str | None]) -> np.ndarray:
    out = [scores(model, *encode(texts[a:b])) for a, b in _groups(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def classify(docs: DataFrame, model: Mil, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, in one pass over the rows."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    at = [f.name for f in kept].index(text)
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for batch in batches:
            s = _scored(model, batch.column(at).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*batch.schema.names, "score", "predicted"])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Mil, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all columns as they are."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def trained(spark: SparkSession, sf_dir: str) -> Mil:
    """The model of the corpus: labels of the training folds of ``labels``, texts of ``documents``."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, trained(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
