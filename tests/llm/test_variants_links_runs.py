"""Spelling variants, embedding links and periodic runs against brute force and odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import queries, runs, spelling, tiles

# --- periodic runs -----------------------------------------------------------------------------


def plain_runs(words, least):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smaller = any(stretch[r:] == stretch[:-r] for r in range(1, q))
            if j > i and len(stretch) >= max(least, 2 * q) and not smaller:
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choices("abcde"[: rng.choice([1, 2, 2, 3, 5])], k=rng.randint(0, 60))
            if rng.random() < 0.5:
                words = words + words[: rng.randint(0, 6)] * rng.randint(1, 9) + words
            texts.append(words)
        assert runs.runs_in(texts, least) == [plain_runs(words, least) for words in texts]


@pytest.mark.parametrize("period", [1, 2, 7, 5000])
def test_long_periodic_texts(period):
    words = [f"w{k % period}" for k in range(150_000)]
    assert runs.runs_in([words]) == [[(0, 150_000, period)]]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_words_full_of_runs():
    words = fibonacci(1000)
    assert runs.runs_in([words], 4) == [plain_runs(words, 4)]
    # All sums of a run's prefix sharing the same letters, and the same text twice.
    assert runs.runs_in([words, words], 4) == [plain_runs(words, 4)] * 2


def test_collapsed_words_keep_the_first_period():
    words = "x y a b a b a b a b a b a b z".split()
    assert runs.runs_in([words]) == [[(2, 12, 2)]]
    assert runs.collapsed(words, [(2, 12, 2)]) == "x y a b z".split()


@pytest.fixture(scope="module")
def repetitive(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        words = rng.choices("abcdefgh", k=rng.randint(0, 50))
        rows.append((k, " ".join(words + words[-3:] * rng.randint(0, 6)), 1, "x"))
    rows += [(None, "a " * 30, None, None), (500, None, 1, "x"), (501, "", 1, "x"), (502, " \n\t ", 1, "x"), rows[3]]
    rows += [(503, "é b " * 20, 1, "x"), (504, "word " * 40_000, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, runs int, length string").repartition(3)


def test_run_query_equals_brute_force(spark, repetitive, monkeypatch, tmp_path):
    repetitive.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    got = Counter(tuple(r) for r in queries.op13(spark, str(tmp_path)).collect())
    want = Counter()
    for row in repetitive.collect():
        words = runs.words_of(row["text"])
        n = len(words)
        h = zlib.crc32(str(row["doc_id"]).encode()) if row["doc_id"] is not None else 1
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        own = plain_runs(words, 12) if n < 1000 else [(0, n, 1)]
        best = min(own, key=lambda run: (-run[1], run[0], run[2]), default=None)
        dropped = {k for s, length, q in own for k in range(s + q, s + length)}
        told = "".join(f"{s},{length},{q}\n" for s, length, q in own)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        want[(row["doc_id"], len(own), *first, *digests)] += 1
    assert got == want


def test_runs_of_an_empty_table(repetitive):
    assert runs.periodic_runs(repetitive.filter("false")).collect() == []


def test_runs_and_text_are_returned(spark):
    docs = spark.createDataFrame([(1, "so it " + "goes on and " * 5 + "on")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(2, 15, 3)] and row["collapsed"] == "so it goes on and on"


# --- spelling variants -------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def varied(rng, word):
    at = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    letter = rng.choice("abcéÿ÷")
    if kind == 0:
        return word[:at] + letter + word[at:]
    return word[:at] + (letter if kind == 1 else "") + word[at + 1 :]


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choices("abcdeéÿ", k=rng.randint(5, 14)))
        for _ in range(8):
            counts[word] = rng.choice([3, 4, 6, 8, 16, 50, 200])
            word = varied(rng, word)
            if len(word) < 5:
                break
    # Anagrams, repeated letters, and two very long words.
    for word in ("abcde", "bacde", "edcba", "aaaaa", "aaaaaa", "aaaab", "é" * 5_000, "é" * 5_001):
        counts[word] = rng.randint(3, 9)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(counts)


def test_signatures_meet_for_every_edit():
    rng = random.Random(9)
    for _ in range(3000):
        word = "".join(rng.choices("aabcdéz", k=rng.randint(5, 12)))
        other = varied(rng, word)
        if len(other) >= 5:
            assert spelling.signatures(word) & spelling.signatures(other), (word, other)


def test_long_chains_have_one_root(spark):
    chain = [("b" * k + "aaaaaaaaaaaaaaaaaaaa"[: 20 - k], 3 * 2**k) for k in range(21)]
    got = spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {"b" * 20}


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS_HELD", 3)
    rows = [
        (1, "Grüße GRÜSSE Straße, straße don't", 1, 1),
        (None, "straße strasse", 2, 2),
        (3, None, 3, 3),
        (4, "", 4, 4),
        (1, "straße", 1, 1),
        (1, "straße", 1, 1),
        (5, "ab cd3ef ÀÀÀÀÀ x×y÷z", 0, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word int").repartition(2)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, fewest=1).collect()}
    assert got == {"grüße": 1, "grÜsse": 1, "straße": 5, "strasse": 1, "ÀÀÀÀÀ": 1, "x×y÷z": 1}
    assert {r["word"] for r in spelling.word_counts(docs).collect()} == {"straße"}
    assert spelling.variants(spelling.word_counts(docs.filter("false"))).collect() == []


def test_misspelt_words_of_the_query(spark, tmp_path):
    rng = random.Random(2)
    words = ["harbour", "library", "réservé", "mountain", "abcdefgh"]
    rows = [(k, " ".join(rng.choices(words, k=30)), 0) for k in range(300)] + [(None, "Harbour harbour", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, form int").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in text.lower().split():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    got = queries.op11(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == plain_variants(counts)
    assert any(r["form"] for r in got)


# --- links among embeddings --------------------------------------------------------------------


def plain_links(rows, threshold):
    def fit(vector, label):
        return label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)

    linked = {k: set() for k in range(len(rows))}
    for a, (_, va, la) in enumerate(rows):
        for b, (_, vb, lb) in enumerate(rows[:a]):
            if fit(va, la) and fit(vb, lb) and la == lb:
                width = max(len(va), len(vb))
                x, y = np.array(va + [0.0] * (width - len(va))), np.array(vb + [0.0] * (width - len(vb)))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    linked[a].add(b)
                    linked[b].add(a)
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        reached, todo = {k}, [k]
        while todo:
            for other in linked[todo.pop()] - reached:
                reached.add(other)
                todo.append(other)
        least = min((rows[r][0] for r in reached if rows[r][0] is not None), default=None)
        out.append((vec_id, len(linked[k]), least, vec_id == least))
    return Counter(out)


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        centre = rng.normal(size=6)
        for _ in range(rng.integers(1, 14)):
            noise = rng.normal(size=6) * rng.choice([0.05, 0.2, 0.35])
            rows.append((len(rows), [float(x) for x in (centre + noise) * 10.0 ** rng.integers(-3, 4)], int(k % 3)))
    rows += [(900 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    rows += [(950, rows[5][1], None), (951, None, 1), (952, [0.0] * 6, 1), (953, [1.0, None], 1), (954, [], 1)]
    rows += [(955, [float("nan"), 1.0], 1), (956, [float("inf"), 1.0], 1), (None, rows[5][1], rows[5][2])]
    rows += [(957, rows[7][1] + [0.0], rows[7][2]), (rows[2][0], *rows[2][1:]), (958, [1e-300, 1e300], 2), (959, [1e300], 2)]
    rows += [(None, [5.0, -3.0, 1.0, 9.0, -2.0, 4.0], 77), (960, [0.0, 1.0], 78), (961, [0.0, 1.0], 78)]
    return rows


@pytest.mark.parametrize("tile_rows", [1, 5, 4096])
@pytest.mark.parametrize("threshold", [0.93, 0.995])
def test_links_equal_brute_force(spark, clusters, tile_rows, threshold, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 3)
    monkeypatch.setattr(tiles, "PAIRS", 2)
    schema = "vec_id long, embedding array<double>, label int, n_links string, node int"
    frame = spark.createDataFrame([(*row, "x", 1) for row in clusters], schema).repartition(3)
    got = Counter(tuple(r) for r in tiles.linked(frame, threshold, tile_rows).collect())
    usable = [(i, None if v and max(map(abs, (x or 0 for x in v)), default=0) > 1e200 and len(v) < 2 else v, t) for i, v, t in clusters]
    usable = [(i, [x / 1e300 for x in v] if v and any(x and abs(x) > 1e200 and np.isfinite(x) for x in v) else v, t) for i, v, t in usable]
    want = plain_links(usable, threshold)
    want = Counter({(i, n, c, i is None and c is None or bool(k)): many for (i, n, c, k), many in want.items()})
    assert got == want


def test_links_of_no_rows(spark, clusters):
    frame = spark.createDataFrame(clusters, "vec_id long, embedding array<double>, label int").filter("false")
    assert tiles.linked(frame).collect() == []


@pytest.mark.parametrize("width", [3, 64, 1500])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    made = rng.normal(size=(60, width)) * 10.0 ** rng.uniform(-3, 3, size=(60, width))
    made[30:] = made[:30] * rng.uniform(0.5, 2) + rng.normal(size=(30, width)) * 0.1 * np.abs(made[:30])
    units = made / np.sqrt((made * made).sum(axis=1, keepdims=True))
    kept = tiles.Quantised(units)
    exact = units @ units.T
    product = (kept.bytes.astype(float) @ kept.bytes.astype(float).T) * kept.scale[:, None] * kept.scale
    room = kept.error[:, None] + kept.error + kept.error[:, None] * kept.error
    assert (np.abs(exact - product) <= room).all()
    for threshold in (0.2, 0.93, 0.99):
        near = kept.near(slice(0, 60), kept, slice(0, 60), threshold)
        clear = np.abs(exact - threshold) > 1e-12
        assert (near == (exact >= threshold))[clear].all()


def test_a_label_of_one_cluster_writes_no_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(k, [float(x) for x in base + rng.normal(size=16) * 0.02], 1) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = tiles.linked(frame, tile_rows=64)
    assert {(r["n_links"], r["component_id"]) for r in got.collect()} == {(299, 0)}
    assert got.filter(F.col("kept")).count() == 1
