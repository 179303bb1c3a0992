"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(score - threshold_k) with one weight per word for all thresholds.  Grade 0
is not toxic.  The labels say only whether a document is toxic, so the grades above 0 come from the
text: toxic documents are split at quantiles of how many different words they hold that mark toxic
documents in the labelled sample; such words (and word beginnings) are the features.  A document is
rejected when P(grade > 0) exceeds 0.5.

Fitting uses a bounded sample: the ``sample`` labelled rows with the smallest hash of their id.  In that
order a row is taken if its text fits into what is left of SAMPLE_BYTES and skipped if not, so the same
rows at every run, and one long text never keeps others out.  Everything else covers all documents and whole texts.

Null and empty texts have no features and take the baseline score.  Labels that are null or whose
document is missing are left out; of several labels of a document the highest counts, of several
texts under a labelled id the shortest, of these the smallest.  Without any toxic label nothing is rejected, and where all
labels are toxic everything.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_slices, release
from .components import cut, discard

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 8_000
#: Bytes of their texts together, at most: a row that doesn't fit any more is skipped.
SAMPLE_BYTES = 64 << 20
#: Words in fewer sampled documents are no features.
MIN_DOCS = 6
#: Features are words that multiply the odds of a toxic document so many times.
LIFT = 2.0
#: Grades of toxic documents.
GRADES = 3
#: Weight of the absolute-value penalty.
PENALTY = 1e-4
ROUNDS = 300

#: Lengths of word beginnings that are features beside whole words: inflected forms share them.
STEMS = (4, 5, 7)

# What is cut off from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str) -> set[str]:
    """Different lower-case words of a text without edge punctuation, and their beginnings (marked by *)."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    words.discard("")
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Model:
    """Weights of the words that matter, and ascending thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        """Exactly rounded sum of weights, so that the order of words doesn't show."""
        import math

        w = self.weights
        return math.fsum(w[f] for f in features(text) & w.keys())

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def fit_ordinal(rows: np.ndarray, words: np.ndarray, n_words: int, grades: np.ndarray, n_grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean log loss of all thresholds plus an absolute-value penalty.

    ``rows`` and ``words`` are the coordinates of the features that are present.  Proximal gradient
    steps with momentum; the step follows the features' largest weighted sum of squares.
    """
    n = len(grades)
    share = np.array([(grades > k).sum() / max(n, 1) for k in range(n_grades - 1)])
    share = np.clip(share, 0.5 / max(n, 1), 1 - 0.5 / max(n, 1))
    theta = np.log((1 - share) / share)
    target = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    w = np.zeros(n_words)
    if not n or not n_words:
        return w, theta

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[words], n)

    def backward(u: np.ndarray) -> np.ndarray:
        return np.bincount(words, u[rows], n_words)

    v = np.random.default_rng(7).normal(size=n_words)
    for _ in range(12):  # power iteration for the curvature bound
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (n_grades - 1) * max(top, 1.0) / n)
    y, y_theta, old, old_theta, t = w.copy(), theta.copy(), w, theta, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(y_theta[None, :] - forward(y)[:, None], -60, 60)))
        error = (p - target) / n
        w = y - step * backward(error.sum(1))
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = np.maximum.accumulate(y_theta + min(step, 4.0) * error.sum(0))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, y_theta = w + (t - 1) / t_next * (w - old), theta + (t - 1) / t_next * (theta - old_theta)
        old, old_theta, t = w, theta, t_next
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the sampled labelled documents.

    Their words are counted where they are found; the one task that fits gets a pair of numbers for each mark of a
    document.  The sample's lengths and labels, the marks and the weights reach the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    # the sample has a fixed bound, so it is the side to broadcast; lengths first, then the texts that fit
    sizes = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__toxic").agg(F.min("bytes").alias("bytes"))
    left, fitting = SAMPLE_BYTES, []
    for r in sorted(sizes.select("__id", "__toxic", "bytes", F.xxhash64("__id").alias("place")).collect(), key=lambda r: (r["place"], r["__id"])):
        if r["bytes"] <= left:
            left -= r["bytes"]
            fitting.append((r["__id"], r["__toxic"], r["bytes"], len(fitting)))
    if not fitting:
        return Model({}, np.full(GRADES, 60.0))
    toxic = np.array([r[1] for r in fitting], np.int64)
    id_type = sizes.schema["__id"].dataType.simpleString()
    kept = docs.sparkSession.createDataFrame(fitting, f"__id {id_type}, __toxic int, bytes long, row int")
    one = texts.join(F.broadcast(kept), ["__id", "bytes"]).groupBy("row", "__toxic").agg(F.min("text").alias("text"))

    def words(piece: pa.RecordBatch) -> dict[str, list]:
        found = [sorted(features(t)) for t in piece.column("text").to_pylist()]
        repeat = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return {"row": piece.column("row").take(pa.array(repeat)), "bad": piece.column("bad").take(pa.array(repeat)), "word": [w for f in found for w in f]}

    each = cut(map_slices(one.select("row", (F.col("__toxic") > 0).cast("long").alias("bad"), "text"), "row int, bad long, word string", words))
    counts = each.groupBy("word").agg(F.sum("bad").alias("hit"), F.count("*").alias("total")).filter(F.col("total") >= min_docs)
    clean = F.col("total") - F.col("hit")
    names = sorted(r["word"] for r in counts.filter(_marking(F.col("hit"), clean, F.sqrt("hit"), F.sqrt(F.greatest(clean, F.lit(1))), len(toxic), int((toxic > 0).sum()), LIFT)).select("word").collect())
    n_words = len(names)
    numbers = docs.sparkSession.createDataFrame(list(zip(names, range(n_words))), "word string, code int")  # noqa: B905

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("row").to_numpy(), b.column("code").to_numpy()) for b in batches]
        if held:
            weights, theta = _learned(*(np.concatenate(x) for x in zip(*held)), n_words, toxic)  # noqa: B905
            seen = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([None] * GRADES + seen.tolist(), pa.int32()), pa.array([*theta.tolist(), *weights[seen].tolist()], pa.float64())], ["code", "value"])

    found = each.join(F.broadcast(numbers), "word").select("row", "code").repartition(1).mapInArrow(learn, "code int, value double").collect() if names else []
    discard(each)
    if not found:
        return Model({}, _learned(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, toxic)[1])
    return Model({names[r["code"]]: r["value"] for r in found if r["code"] is not None}, np.sort([r["value"] for r in found if r["code"] is None]))


def fit_words(table: pa.Table, min_docs: int = MIN_DOCS) -> Model:
    """The model of labelled documents in memory: place (an order that doesn't depend on how rows arrived), toxic and words."""
    place, toxic, words = (table.column(c).to_pylist() for c in ("place", "toxic", "words"))
    if not place:
        return Model({}, np.full(GRADES, 60.0))
    order = np.lexsort((toxic, place)).tolist()
    toxic, words = np.array(toxic, np.int64)[order], [words[i] for i in order]
    counts = Counter(w for ws in words for w in ws)
    names = sorted(w for w, n in counts.items() if n >= min_docs)
    for strong in (False, True):
        number = {w: i for i, w in enumerate(names)}
        rows, code = np.array([(r, number[w]) for r, ws in enumerate(words) for w in ws if w in number], np.int64).reshape(-1, 2).T
        if not strong:
            names = [names[i] for i in np.flatnonzero(marks(rows, code, len(names), toxic))]
    w, theta = _learned(rows, code, len(names), toxic)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, theta)


def _learned(rows: np.ndarray, code: np.ndarray, n_words: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the marks (code) of documents (rows)."""
    order = np.lexsort((code, rows))  # sums of doubles run in the order of the sample, not of arrival
    w, theta = fit_ordinal(rows[order], code[order], n_words, severity_grades(rows, toxic), GRADES + 1)
    if not (toxic > 0).any():
        w[:] = 0
        theta[:] = 60.0
    return w, theta


def marks(rows: np.ndarray, words: np.ndarray, n_words: int, toxic: np.ndarray, lift: float = LIFT) -> np.ndarray:
    """Which features multiply the odds that a document is toxic by ``lift`` at least, both counts moved against it by 1.5 standard errors.

    The odds are held against those of all documents, so any share of toxic ones leaves features.  If
    all documents are toxic or none is, nothing marks.
    """
    hit, total = np.bincount(words, (toxic[rows] > 0).astype(float), n_words), np.bincount(words, minlength=n_words)
    clean = total - hit
    return _marking(hit, clean, np.sqrt(hit), np.sqrt(np.maximum(clean, 1)), len(toxic), int((toxic > 0).sum()), lift)


def _marking(hit, clean, hit_error, clean_error, n: int, bad: int, lift: float):
    """The rule of ``marks`` over arrays or columns: toxic and other documents of a feature, and the standard errors of both."""
    low, high = hit - 1.5 * hit_error, clean + 1.5 * clean_error
    return (low > 0) & (low * (n - bad) >= lift * high * bad)


def severity_grades(rows: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for documents that are not toxic; 1 and up by quantiles of the number of marks in toxic ones.

    ``rows`` has a document's number once for each of its marks.
    """
    bad = toxic > 0
    out = np.zeros(len(toxic), np.int64)
    if bad.any():
        count = np.bincount(rows, minlength=len(toxic))
        out[bad] = 1 + np.searchsorted(np.quantile(count[bad], np.arange(1, grades) / grades), count[bad], side="left")
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity_score, grade probabilities, expected_severity, grade and is_toxic of each whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, severity_score double, grade_probabilities array<double>, expected_severity double, severity_grade int, is_toxic boolean"

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        scores = [model.score(t) for t in piece.column("text").to_pylist()]
        above = [model.above(s) for s in scores]
        return {
            "id": piece.column("id"),
            "severity_score": scores,
            "grade_probabilities": [(-np.diff(np.concatenate([[1.0], p, [0.0]]))).tolist() for p in above],
            "expected_severity": [float(p.sum()) for p in above],
            "severity_grade": [int((p > 0.5).sum()) for p in above],
            "is_toxic": [bool(p[0] > 0.5) for p in above],
        }

    return map_slices(src, schema, fn).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:  # few texts at a time as Python strings
        some = (texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256))
        out = pa.array([bool(model.above(model.score(t))[0] > 0.5) for part in some for t in part], pa.bool_())
        release()
        return out

    return docs.filter(~toxic(F.coalesce(F.col(text_col), F.lit(""))))
