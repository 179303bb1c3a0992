import collections
import hashlib
import random
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components as C, embed_dedup, line_dedup, minhash_dedup, suffix_dedup
from .conftest import AWKWARD


def _union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def _words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 9999)}"
    return words


# ------------------------------------------------------------ components


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "LOCAL", limit)
    rng = random.Random(limit)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame([*links, (None, 3), (4, 4)], "a long, b long")).collect()}
    assert got == _union({n for pair in links for n in pair if pair[0] != pair[1]}, links)


# ------------------------------------------------------------ MinHash


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near(rows):
    sets = {i: _shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    parts = _union(ids, links)
    return {i: (len(sets[i]), parts[i], parts[i] == i) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows, n = [], 0
    passage = _words(rng, 40)
    for _ in range(25):
        base = _words(rng, rng.choice([3, 6, 30, 120]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((n, " ".join(_edited(rng, base, rng.randint(0, max(0, len(base) // 25))))))
            n += 1
    for _ in range(30):  # a crowd around one passage, and a family of near copies
        rows.append((n, " ".join([*_words(rng, rng.randint(5, 30)), *passage])))
        rows.append((n + 1, " ".join(_edited(rng, passage * 2, 2)).upper()))
        n += 2
    return rows + [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "ONE \t two"), (n + 4, "x" * 3000), (n + 5, "é " * 4000)]


def test_minhash(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    want = _near(corpus)
    assert got == want
    kept = {r.doc_id for r in minhash_dedup.keep_one(docs).collect()}
    assert kept == {i for i, w in want.items() if w[2]}


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**63, 300, np.uint64)
    a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 100, np.uint64)])) for _ in range(2))
    s = minhash_dedup.sketches([a, b, both[:3]])
    assert (s != np.iinfo(np.uint64).max).all()  # every coordinate is filled, whatever the size of the set
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_long_texts_in_segments(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(3000)) + " " + "y" * 900).encode()
    raw = np.frombuffer(text, np.uint8)
    whole = minhash_dedup.word_hashes(raw)
    monkeypatch.setattr(minhash_dedup, "_SEGMENT", 100)
    assert (minhash_dedup.word_hashes(raw) == whole).all()


def test_minhash_awkward(awkward, nothing, spark):
    got = minhash_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[5]] == [1] and [r.component_id for r in by[1]] == [1, 1] and by[None][0].component_id is None and by[None][0].kept
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (2, 3, 4))
    assert minhash_dedup.near_duplicates(nothing).collect() == [] and minhash_dedup.keep_one(nothing).collect() == []
    kept = [r.doc_id for r in minhash_dedup.keep_one(awkward).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 9, 10, None], key=str)


def test_only_mixed_bucket(spark, monkeypatch):
    """2 and 3 are similar; 1 links with nothing, and 4, the other end of their bucket, is too long for a try."""
    rng = random.Random(21)
    common = _words(rng, 40)
    rows = [(1, " ".join(_words(rng, 40))), (2, " ".join(common)), (3, " ".join([*common, "more"])), (4, " ".join(_words(rng, 400)))]
    profile = minhash_dedup.profile
    monkeypatch.setattr(minhash_dedup, "profile", lambda *a: profile(*a).withColumn("bands", F.array(F.lit(7).cast("long"))))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


def test_keep_one_shared_ids(spark):
    """Different texts under one id are judged apart: none is lost because another has a near copy."""
    rng = random.Random(22)
    x, y, z = (_words(rng, 60) for _ in range(3))
    near = lambda w, end: " ".join([*w, end])
    rows = [(3, near(x, "a")), (5, near(x, "b")), (5, near(y, "c")), (5, near(y, "c")), (5, near(z, "d")), (7, near(y, "e")), (None, near(x, "f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)


# ------------------------------------------------------------ suffixes


def _cut(texts, depth):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        out.append((sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("depth", "letters"), [(8, "ab"), (40, "abé")])
def test_suffixes(spark, depth, letters):
    rng = random.Random(depth)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, depth - 1, depth, 2 * depth, 200]))) for _ in range(20)]
    texts = [*base, None, base[3], base[5] + base[7], "a" * 90, "ab" * 70, *(t for _, t in AWKWARD)]
    for _ in range(20):
        x = list(rng.choice(base) + rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(letters)
        texts.append("".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in suffix_dedup.repeats(docs, depth, with_kept=True).collect()}
    want = _cut(texts, depth)
    assert [(rows[i].n_removed, len(rows[i].spans), bytes(rows[i].kept)) for i in range(len(texts))] == want
    assert all(rows[i].kept_sha256 == hashlib.sha256(want[i][2]).hexdigest() for i in rows)


def test_suffix_stretches(monkeypatch):
    raw = np.frombuffer(np.random.default_rng(3).integers(97, 100, 900, np.uint8).tobytes(), np.uint8)
    whole = suffix_dedup.anchors(raw, 40)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 128)
    parts = suffix_dedup.anchors(raw, 40)
    place = lambda x: {(s, p) for h, p, a, b, _ in zip(*x, strict=True) for s in range(a, b + 1)}
    assert place(whole) == place(parts)


@pytest.mark.parametrize("stretch", [5, 64, 128, 301])
def test_suffix_stretches_join(monkeypatch, stretch):
    """A stretch boundary leaves no trace: one row per anchor position, extents included."""
    raw = np.random.default_rng(4).integers(97, 100, 900, np.uint8)
    whole = suffix_dedup.anchors(raw, 40)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    parts = suffix_dedup.anchors(raw, 40)
    assert len(set(parts[1].tolist())) == len(parts[1])
    assert [c.tolist() for c in parts] == [c.tolist() for c in whole]


def test_suffix_long_text(spark):
    """Workers import STRETCH anew, so a text is made longer than two stretches; what repeats lies at one boundary, and at the other nothing does."""
    rng, n = np.random.default_rng(6), suffix_dedup.STRETCH
    text = rng.integers(97, 123, 2 * n + 900, np.uint8).tobytes().decode()
    other = "".join(rng.permutation(list("0123456789" * 20)))
    texts = [text, other + text[n - 70 : n + 90] + other[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.repeats(docs, 40, with_kept=True).collect()}
    assert [(rows[i].n_removed, len(rows[i].spans), bytes(rows[i].kept)) for i in range(2)] == _cut(texts, 40)


def _in_passages(texts, words):
    """Words of each text that lie in a string of so many words that stands elsewhere too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    return [len({j for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for j in range(i, i + words)}) for w in split]


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 3])
def test_suffix_crowded(spark, monkeypatch, chunk):
    """A passage within different surroundings, near copies of one text, copies of another: groups dealt over parts and crowded keys, for bytes and words."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "CROWD", 4 if chunk == 3 else 1000)
    rng = random.Random(7)
    shared, base = " ".join(_words(rng, 14)), _words(rng, 60)
    texts = [" ".join(_words(rng, rng.randint(0, 12))) + rng.choice([" ", "\n", "  "]) + shared + " " + " ".join(_words(rng, rng.randint(0, 12))) for _ in range(25)]
    texts += [" ".join(_edited(rng, base, 3)) for _ in range(20)] + [" ".join(base)] * 9 + [" ".join(_words(rng, 40)) for _ in range(10)] + [None, "", "short"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in suffix_dedup.repeats(docs, 60, with_kept=True, passage=9).collect()}
    assert [(rows[i].n_removed, len(rows[i].spans), bytes(rows[i].kept)) for i in range(len(texts))] == _cut(texts, 60)
    assert [rows[i].n_passage_words for i in range(len(texts))] == _in_passages(texts, 9)


@pytest.mark.parametrize("words", [False, True])
def test_radix(words):
    """Groups of equal windows of stretches around one anchor."""
    rng = random.Random(1)
    for depth in (8, 9, 21, 40):
        unit = suffix_dedup.Unit(depth, words)
        anchor, bodies, place, count = [rng.randint(0, 255) for _ in range(unit.key)], [], [], []
        for _ in range(12):
            lo = rng.randint(0, depth - unit.key)
            hi = rng.randint(0, lo)
            around = [[2 if rng.random() < 0.05 else 1 for _ in range(n)] for n in (lo, depth - unit.key - hi)]
            bodies.append(np.array(around[0] + anchor + around[1], np.uint64 if words else np.uint8))
            place.append(lo)
            count.append(lo - hi + 1)
        group, many = suffix_dedup.radix(np.zeros(12, int), np.array(place), bodies, np.array(count), unit)
        windows = [(place[i] - s, bodies[i][s : s + depth].tobytes()) for i in range(12) for s in range(count[i])]
        times, names = collections.Counter(windows), {}
        assert [times[w] > 1 for w in windows] == many.tolist()
        assert all(names.setdefault(w, g) == g for w, g in zip(windows, group.tolist(), strict=True)) and len(set(names.values())) == len(times)


def test_word_hashes(monkeypatch):
    text = "one two  three\tone\x0btwo " + "x" * 300 + " one " + "y" * 299
    whole = suffix_dedup.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert len(whole) == len(text.split()) and whole[0] == whole[3] == whole[6] and whole[1] == whole[4] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(suffix_dedup, "STRETCH", 16)
    parts = suffix_dedup.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert parts[0] == parts[3] == parts[6] and len(set(parts.tolist())) == 5


def test_suffix_awkward(awkward, nothing):
    assert len(suffix_dedup.repeat_query(awkward).collect()) == len(AWKWARD)
    assert suffix_dedup.repeat_query(nothing).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.sizes(4)


# ------------------------------------------------------------ embeddings


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))
    rows = [v for v in base] + [base[0] + 0.03 * rng.normal(size=24) for _ in range(60)] + [base[i] + 0.25 * rng.normal(size=24) for i in range(20)] + [base[1]] * 5 + [3 * base[2]]
    ids = list(range(len(rows)))
    data = [(i, v.tolist()) for i, v in zip(ids, rows, strict=True)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, []), (905, [float("inf")] + [1.0] * 23), (None, base[1].tolist()), (906, base[3][:7].tolist()), (907, (2 * base[3][:7]).tolist()), (1, base[1].tolist())]
    df = spark.createDataFrame([(i, v, "d", 1) for i, v in data + odd], "vec_id long, embedding array<double>, digest string, dim int").repartition(3)
    got = collections.defaultdict(list)
    for r in embed_dedup.near_duplicates(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    full = np.array([*rows, base[1]])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    owner = [*ids, 1]
    parts = _union(ids, [(owner[a], owner[b]) for a, b in np.argwhere(near) if owner[a] != owner[b]])
    for k, i in enumerate(owner):
        assert (int(near[k].sum()), parts[i], parts[i] == i) in got[i]
    assert all(got[i] == [(0, i, True)] for i in (900, 901, 902, 903, 904, 905)) and got[None] == [(0, None, True)]
    assert got[906] == [(1, 906, True)] and got[907] == [(1, 906, False)]
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_planted_recall(spark):
    """Pairs planted just above the threshold among random vectors: all are found, and what is just below isn't linked."""
    rng = np.random.default_rng(21)
    n, dim = 1200, 32
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(n, dim))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = np.where(np.arange(n) % 4 == 0, 0.9495, 0.9505)[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * other
    rows = np.concatenate([base, near])
    linked = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)).collect()}
    exact = (rows @ rows.T >= 0.95).sum(1) - 1
    # measured recall against brute force: 1.0
    assert [linked[i] for i in range(2 * n)] == exact.tolist() and sum(exact) >= 2 * n * 3 // 4


def test_shared_folder():
    """Without the setting only a local session falls back to its warehouse."""
    session = lambda master, **conf: types.SimpleNamespace(conf={"spark.sql.warehouse.dir": "/w/"} | {k.replace("_", "."): v for k, v in conf.items()}, sparkContext=types.SimpleNamespace(master=master))
    assert C.checkpoint_dir(session("local[4]")) == "/w/_checkpoints" and C.checkpoint_dir(session("spark://host:7077", spark_checkpoint_dir="s3://shared/")) == "s3://shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            C.checkpoint_dir(session(master))


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    table = C.cut(spark.range(1000))
    marked = lambda: "broadcast" in C.checked(table)._jdf.queryExecution().logical().toString().lower()
    assert marked()
    monkeypatch.setattr(C, "BROADCAST_BYTES", 100)
    assert not marked()


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = embed_dedup.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(embed_dedup.hadamard(y), x)


# ------------------------------------------------------------ lines


def _later(rows, similar=80):
    out, sets, seen = {}, [], set()
    for i, text in sorted(rows):
        kept, removed = [], []
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w)
            hit = bool(s) and (s in seen or any(100 * len(s & o) >= similar * len(s | o) for o in sets))
            if s and s not in seen:
                seen.add(s)
                sets.append(s)
            (removed if hit else kept).append(n if hit else line)
        out[i] = ("\n".join(kept), removed)
    return out


@pytest.mark.parametrize("crowd", [2, 256])
def test_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(12)
    stock = [_words(rng, rng.choice([1, 2, 5, 12, 40])) for _ in range(30)]
    lines = lambda: "\n".join(" ".join(_edited(rng, w, rng.choice([0, 0, 1, 2]))) if rng.random() < 0.9 else "" for w in rng.choices(stock, k=rng.randint(0, 9)))
    rows = [(i, lines()) for i in range(40)] + [(50, "\t\n \n"), (51, "A b\tc\n a  B c ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == _later(rows)


def test_lines_order(spark):
    """Rare words come first, each with the class that a count of all lines gives it, and the sets are what the texts hold."""
    docs = spark.createDataFrame([(i, f"common  Common\t{'often' if i % 4 else 'seldom'} only{i}\n\n") for i in range(40)], "doc_id long, text string")
    hashed = C.cut(line_dedup._hashed(docs, "doc_id", "text"))
    code = {w: h for w, h in spark.createDataFrame([(w,) for w in ("common", "often", "seldom", *(f"only{i}" for i in range(40)))], "w string").select("w", line_dedup._word("w")).collect()}
    assert len({h >> 36 for h in code.values()}) == len(code)  # no two of these words share a counter
    rows = hashed.select("id.id", line_dedup.rarest_first(F.col("words"), line_dedup.rarity_table(hashed)).alias("words")).collect()
    counts = {"common": 40, "often": 30, "seldom": 10}
    for i, words in rows:
        want = [f"only{i}", "often" if i % 4 else "seldom", "common"]
        assert words == [line_dedup._frequency(counts.get(w, 1)) << 56 | code[w] for w in want]
    assert len(rows) == 40


def test_lines_rarity_outside_the_plan(spark):
    """The counters are in no plan's text (as a literal they took 8 MB of it, on the driver), and every counter has its class."""
    docs = spark.createDataFrame([(i, f"common {'often' if i % 4 else 'seldom'} only{i}") for i in range(40)], "doc_id long, text string")
    hashed = C.cut(line_dedup._hashed(docs, "doc_id", "text"))
    name = "rarity_of_this_test"
    try:
        rarity = line_dedup.rarity_table(hashed, name)
        lines = line_dedup._lines(hashed, rarity)
        assert len(lines._jdf.queryExecution().toString()) < 100_000
        [(table,)] = spark.range(1).select(rarity).collect()
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
    counts = collections.Counter(w >> (56 - line_dedup.BITS) for r in hashed.collect() for w in r.words)
    assert len(table) == 1 << line_dedup.BITS
    assert {k: c for k, c in enumerate(table) if c} == {k: line_dedup._frequency(n) for k, n in counts.items()}


def test_lines_white_space(spark):
    """Every kind of white space parts words, without a regular expression."""
    docs = spark.createDataFrame([(1, "\r b\x0bC\fa\t\tb \n\t \x0b\nb  c a")], "doc_id long, text string")
    hashed = line_dedup._hashed(docs, "doc_id", "text")
    assert "\\s" not in hashed._jdf.queryExecution().toString()
    code = {w: h for w, h in spark.createDataFrame([(w,) for w in "abc"], "w string").select("w", line_dedup._word("w")).collect()}
    assert {r.line: r.words for r in hashed.collect()} == {0: [code[w] for w in "bca"], 2: [code[w] for w in "bca"]}


def test_lines_largest_partner(spark):
    """The filter by length and position lets through exactly the sizes that can reach the similarity."""
    rows = spark.range(1, 80).selectExpr("cast(id as int) AS n").selectExpr("n", "explode(sequence(0, n - 1)) AS at")
    for n, at, most in rows.select("n", "at", line_dedup._largest_partner(F.col("n"), F.col("at")).alias("most")).collect():
        assert all((m <= most) == (100 * (n - at) >= 80 * m + 80 * at) for m in range(n, 130)), (n, at, most)


def test_lines_shared_ids(spark):
    """A line goes only in the rows that hold it; equal lines at equal numbers of different rows remove each other."""
    rows = [(None, "one two three\nfour five six"), (None, "seven eight nine\nten eleven twelve"), (None, "thirteen fourteen\nfour five six"), (4, "one two three\nalone here"), (4, "seven eight nine\nnobody else")]
    got = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    rest = {"seven eight nine\nten eleven twelve", "alone here", "nobody else"}
    assert got in (rest | {rows[0][1], "thirteen fourteen"}, rest | {"one two three", rows[2][1]})


def test_lines_awkward(awkward, nothing):
    out = line_dedup.dedup_lines(awkward)
    rows = out.collect()
    assert out.columns == [*awkward.columns, "removed_lines"] and len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows if r.doc_id != 1}
    assert by[2].text is None and by[5].text == "" and by[7].text == "é ß 中文 \U0001f600 ¿qué?\n" and len(by[7].removed_lines) == 29
    assert len(line_dedup.line_query(awkward).collect()) == len(AWKWARD)
    assert line_dedup.line_query(nothing).collect() == []
