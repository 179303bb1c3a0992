import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ledgerloom.llm import secret_scan as S, toxicity as T
from .conftest import AWKWARD


def _base(text):
    """The contract's patterns by Python's re, letters of names in either case (ASCII)."""
    out = []
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for rank, (kind, pattern) in enumerate((("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def _entropy(text):
    out = []
    for c in S.CLASSES:
        for m in re.finditer("[" + re.escape(c.alphabet) + "]{%d,}" % c.least, text):
            if any(not re.search(p, m[0]) for p in c.needs) or any(re.search(p, m[0]) for p in S.ALLOWED):
                continue
            hot = [i for i in range(len(m[0]) - c.window + 1) if sum(round(n * math.log2(n) * S.MICRO) for n in __import__("collections").Counter(m[0][i : i + c.window]).values()) <= c.most_sum]
            if hot:
                out.append((m.start() + hot[0], S.KINDS.index(c.kind), m.start() + hot[-1] + c.window, c.kind))
    return out


def _show(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def _texts():
    rng = random.Random(2)
    alphabet = "abcdefABCDEF0123456789GHIJKLMNOPxyz+/_-"
    pieces = ["password=", "Token : '", "API_KEY=", "secret\": \"", "AKIA", "AKIAAKIA", " ", "\n", "é中", "ſecret=", "toKen=", "passwd = ", "12345678-1234-1234-1234-123456789abc ", "exampleexample0123x "]
    for _ in range(400):
        yield "".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice(alphabet[: rng.choice([12, 22, 39])]) for _ in range(rng.randint(1, 45))) for _ in range(rng.randint(0, 8)))
    yield "token=password: abcdefghijklmnop token=secret=abcdefghijklmn"
    yield from (t or "" for _, t in AWKWARD)


def test_spans(spark):
    texts = list(_texts())
    rows = {r.doc_id: r for r in S.secret_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(bool(_entropy(t)) for t in texts) > 40
    for i, t in enumerate(texts):
        base = _base(t)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex")), t
        assert rows[i].base_sha256 == hashlib.sha256(_show(base).encode()).hexdigest()
        assert rows[i].spans == _show(base + _entropy(t)), t


def test_redact(spark, awkward, nothing):
    texts = list(_texts())
    rows = {r.doc_id: r.text for r in S.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, _, b, _ in sorted(_base(t) + _entropy(t)):
            if a >= at:
                out += t[at:a] + S.MASK
            at = max(at, b)
        assert rows[i] == out + t[at:]
    clean = S.redact(awkward)
    assert clean.columns == awkward.columns and {r.doc_id: r.text for r in clean.collect()}[2] is None
    assert S.secret_query(nothing).collect() == [] and S.redact(nothing).collect() == []


def _labelled(n, seed):
    rng = random.Random(seed)
    bad = ["vilest", "grubby", "loathed", "wretch"]
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            words += [rng.choice(bad) + rng.choice(["", "s", "ly", "est"]) for _ in range(rng.randint(1, 9))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark, awkward, nothing):
    rows = _labelled(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[i].is_toxic == bool(t) for i, _, t in held]) > 0.97
    assert all(abs(sum(got[i].grade_probabilities) - 1) < 1e-9 for i, _, _ in held)
    # the more marks, the higher the expected severity
    mild, strong = T.score(spark.createDataFrame([(1, "some vilest words"), (2, "vilest grubby loathed wretch wretchs")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert mild.expected_severity < strong.expected_severity
    assert {r.doc_id for r in T.drop_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.is_toxic}
    assert len(T.score(awkward, model).collect()) == len(AWKWARD) and T.drop_toxic(awkward, model).columns == awkward.columns
    assert T.score(nothing, model).collect() == []
    # the same rows and labels give the same model, whatever their order
    again = T.fit(docs.repartition(5), labels.repartition(3))
    assert again.weights.keys() == model.weights.keys() and np.allclose(again.thresholds, model.thresholds)


@pytest.mark.parametrize("share", [0.02, 0.4, 0.6, 0.9])
def test_any_toxic_share(share):
    """Marks are found at any share of toxic documents, and clean documents stay."""
    rows = _labelled(12_000, 2)
    bad, good = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    n = round(2000 * share)
    train, held = bad[:n] + good[: 2000 - n], bad[n:] + good[2000 - n :]
    model = T.fit_words(pa.table({"place": [r[0] for r in train], "toxic": [r[2] for r in train], "words": [sorted(T.features(r[1])) for r in train]}))
    verdict = {i: model.above(model.score(t))[0] > 0.5 for i, t, _ in held}
    assert np.mean([verdict[i] for i, _, t in held if t]) > 0.9 and np.mean([verdict[i] for i, _, t in held if not t]) < 0.05


def test_severity_orders_what_features_do_not_hold():
    """Half of the offensive words are hidden from fit and score; on held-out toxic documents the expected severity still follows how many of the hidden ones a document has."""
    bad, rng = [f"vile{i}" for i in range(40)], random.Random(5)
    hidden = set(bad[::2])
    rows = []
    for i in range(6000):
        words = [f"word{rng.randint(0, 400)}" for _ in range(40)]
        level = rng.choice([1, 3, 9]) if i % 5 == 0 else 0
        rows.append((i, words + [rng.choice(bad) for _ in range(2 * level)], int(level > 0)))
    seen = [(i, " ".join(w for w in words if w not in hidden), t, sum(w in hidden for w in words)) for i, words, t in rows]
    train, held = seen[:4000], [r for r in seen[4000:] if r[2]]
    model = T.fit_words(pa.table({"place": [r[0] for r in train], "toxic": [r[2] for r in train], "words": [sorted(T.features(r[1])) for r in train]}))
    severity = np.array([model.above(model.score(text)).sum() for _, text, _, _ in held])
    assert pd.Series(severity).corr(pd.Series([r[3] for r in held]), method=lambda x, y: np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]) > 0.6


def test_sample_bytes(spark, monkeypatch):
    """A sample of very long texts is bounded by its bytes."""
    docs = spark.createDataFrame([(i, ("vilest " if i % 2 else "plain ") * 50 + f"w{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert T.fit(docs, labels).weights
    monkeypatch.setattr(T, "SAMPLE_BYTES", 1000)
    assert not T.fit(docs, labels).weights  # too few documents for any feature


def test_long_text_is_skipped(spark, monkeypatch):
    """A text beyond the bound, wherever it stands in the sample, leaves the others in it."""
    rows = _labelled(400, 3)
    monkeypatch.setattr(T, "SAMPLE_BYTES", 200_000)
    docs = [r[:2] for r in rows]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    first = labels.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    schema = "doc_id long, text string"
    without = T.fit(spark.createDataFrame([d for d in docs if d[0] != first], schema), labels)
    long = T.fit(spark.createDataFrame([(i, t if i != first else "vilest " * 40_000) for i, t in docs], schema), labels)
    assert long.weights and long.weights == without.weights and np.array_equal(long.thresholds, without.thresholds)
    scored = T.score(spark.createDataFrame(docs, schema), long).collect()
    assert sum(r.is_toxic for r in scored) > 40


def test_one_task_gets_numbers(spark, monkeypatch):
    """No task but those that read texts holds words of the sample: the one that fits gets pairs of numbers, and its model is that of all words in memory."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = _labelled(1200, 6)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    given, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **b: given.append(self.schema) or plain(self, *a, **b))
    model = T.fit(docs, labels)
    assert len(given) == 2 and [f.dataType.simpleString() for f in given[-1]] == ["int", "int"]
    place = {r.doc_id: r.place for r in docs.select("doc_id", F.xxhash64("doc_id").alias("place")).collect()}
    whole = T.fit_words(pa.table({"place": [place[r[0]] for r in rows], "toxic": [r[2] for r in rows], "words": [sorted(T.features(r[1])) for r in rows]}))
    assert model.weights == whole.weights and np.array_equal(model.thresholds, whole.thresholds) and model.weights


def test_score_by_hand(spark):
    """The query's columns from weights and thresholds, one document at a time, without arrays."""
    rows = _labelled(300, 4)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "!! vilest, 'VILESTly'")], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    for r in T.score(docs, model).join(docs, "doc_id").collect():
        found = set()
        for word in (r.text or "").lower().split():
            word = word.strip(T.EDGES)
            found |= {word} | {word[:n] + "*" for n in (4, 5, 7) if len(word) > n}
        score = sum(model.weights.get(f, 0.0) for f in found)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r.severity_score == pytest.approx(score) and r.expected_severity == pytest.approx(sum(above))
        assert r.grade_probabilities == pytest.approx([a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)])
        assert r.severity_grade == sum(a > 0.5 for a in above) and r.is_toxic == (above[0] > 0.5)


def test_one_class_has_no_marks():
    rows, words = np.arange(20), np.zeros(20, np.int64)
    assert not T.marks(rows, words, 1, np.ones(20, np.int64)).any() and not T.marks(rows, words, 1, np.zeros(20, np.int64)).any()


def test_no_toxic_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert not any(r.is_toxic for r in T.score(docs, model).collect())
    assert not any(r.is_toxic for r in T.score(docs, T.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))).collect())


def test_ordinal_gradient():
    """The fit beats every nearby set of parameters."""
    rng = np.random.default_rng(0)
    rows, words = np.divmod(np.flatnonzero(rng.random((200, 6)) < 0.4), 6)
    x = np.zeros((200, 6))
    x[rows, words] = 1
    grades = np.clip((x @ [2, 1, 0, 0, -1, 0] + rng.logistic(size=200)).round(), 0, 3).astype(int)
    w, th = T.fit_ordinal(rows, words, 6, grades, 4, 1e-3, 2000)

    def loss(w, th):
        z = th[None, :] - (x @ w)[:, None]
        hit = grades[:, None] > np.arange(3)
        return np.mean(np.sum(np.log1p(np.exp(np.where(hit, z, -z))), 1)) + 1e-3 * np.abs(w).sum()

    best = loss(w, th)
    assert all(loss(w + 0.02 * rng.normal(size=6), th + 0.02 * rng.normal(size=3)) >= best - 1e-6 for _ in range(200))
