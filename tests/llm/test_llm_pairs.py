"""Spelling variants, hard negatives and repeated word strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgrain.llm import hard_negatives, seed_extend, spelling_variants
from tests.llm.test_llm_corpus import words


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 5
    known = {w: n for w, n in counts.items() if n >= 3}
    near, holes = defaultdict(set), defaultdict(set)
    for w in known:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            holes[less, k, len(w)].add(w)
            if less in known:
                near[w].add(less)
                near[less].add(w)
    for members in holes.values():
        for w in members:
            near[w] |= members - {w}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), known.get(form.get(w))))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    parts = ["ba", "ne", "ki", "ou", "sé", "À", "st", "r"]
    rows = [(i, " ".join(rng.choice([str.upper, str, str.title])("".join(rng.choices(parts, k=rng.randint(2, 5)))) for _ in range(200))) for i in range(120)]
    rows += [(None, "Étagère étagère " * 9), (200, None), (201, ""), (202, "é" * 40 + " x" * 3)]
    rows += [(203, ("q" * 900 + " ") * 4 + ("q" * 450 + "p" + "q" * 450 + " ") * 9 + "×÷abcd 123 " * 4)]
    return rows + [rows[3]] * 3


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 30, "STATES": 500, "PIECE_BYTES": 50, "BLOCK_WORDS": 60}])
def test_variants(spark, spelled, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling_variants, name, value)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in spelled], "doc_id bigint, text string, word string, n int").repartition(3)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group(docs).collect()}
    assert got == brute_variants(spelled)
    assert any(r[1] != r[2] and r[1] for r in got)


def test_scan_finds_each_pair_once():
    rng = random.Random(1)
    for _ in range(40):
        m = rng.randint(2, 6)
        line = sorted({"".join(rng.choices("abé", k=rng.randint(m, m + 1))) for _ in range(60)})
        bound = rng.choice([1 << 30, 1, 2])
        n = len(line)
        one, other = spelling_variants.near_pairs(line, np.zeros(n, int), np.full(n, m), np.full(n, bound))
        want = set()
        for a in range(n):
            for b in range(a + 1, n):
                x, y = sorted((line[a], line[b]), key=len)
                same = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
                edit = x[same + 1 :] == y[same + 1 :] if len(x) == len(y) == m else len(x) < len(y) and x[same:] == y[same + 1 :]
                want |= {(a, b)} if edit and same < bound else set()
        assert sorted(zip(one.tolist(), other.tolist(), strict=True)) == sorted(want)


def test_no_pairs_among_very_long_words_without_edits():
    long = ["a" * 3000, "a" * 1500 + "b" + "a" * 1500, "c" * 3000]
    one, other = spelling_variants.near_pairs(long, np.zeros(3, int), np.full(3, 3000), np.full(3, 1 << 30))
    assert (one.tolist(), other.tolist()) == ([0], [1])


def brute_negatives(rows):
    taken = set()
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(max(-(2**23), min(2**23, math.floor(256 * float(np.float32(x))))) for x in vector)
        taken.add((i, whole, label))
    order = lambda i: 2**70 if i is None else i
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, vector, label in taken:
        if i is None or i % 100:
            continue
        line = sorted((-dot(vector, w), order(j), j, m) for j, w, m in taken if j != i)
        for positive, _, j, _ in [x for x in line if x[3] == label][:5]:
            fit = [(k, s) for s, _, k, m in line if m != label and 80 * -positive <= 100 * -s <= 100 * -positive][:5]
            out += [(i, j, rank + 1, k, -positive, -s) for rank, (k, s) in enumerate(fit)]
    return out


@pytest.mark.parametrize("limits", [{}, {"TASK_ROWS": 100, "CHUNK_ROWS": 30, "BLOCK_ANCHORS": 2, "ROUND_BYTES": 600}])
def test_negatives(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        v = rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 10))))
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(150)]
    rows += [(2000, None, 1), (2001, [0.1] * 16, None), (2002, [float("nan")] * 16, 1), (2003, [0.1, None], 1), (2004, [float("inf")], 1)]
    rows += [(None, rows[7][1], 2), (None, rows[8][1], 3), (2100, [], 1), (2200, [0.5] * 9, 4), (2201, [0.5] * 20, 4)]
    rows += [(2300, [1e9, -3e38, *[0.0] * 14], 5), (2301, [1e9, -1e30, *[0.01] * 14], 5), (2302, [1e9, -1e30, *[0.01] * 14], 6)]
    rows += [(300, rows[300][1], 9), rows[300], rows[300], (2400, [0.0] * 16, 5), (2401, [0.0] * 16, 6)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, id string, score int").repartition(3)
    table = table.withColumn("vector", hard_negatives.whole_vectors(F.col("embedding"), 256))
    got = [tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got, key=str) == sorted(brute_negatives(rows), key=str) and got


def test_bit_planes_give_inner_products():
    rng = np.random.default_rng(0)
    for width in (1, 8, 13, 64):
        a, c = (rng.integers(-300, 300, size=(n, width)) for n in (7, 50))
        planes = hard_negatives.planes_of(c)
        assert (hard_negatives.scores(planes, hard_negatives.subset_sums(a, planes.shape[1], np.int64)) == c @ a.T).all()


def brute_repeats(rows):
    """Rows without id have the numbers that the third field gives."""
    lines = [(text or "").encode().split() for _, text, _ in rows]
    first = {}
    for (_, _, number), line in zip(rows, lines, strict=True):
        for a in range(len(line) - 12):
            key = tuple(line[a : a + 13])
            first[key] = min(first.get(key, number), number)
    out = []
    for (i, _, number), line in zip(rows, lines, strict=True):
        gone = [False] * len(line)
        for a in range(len(line) - 12):
            if first[tuple(line[a : a + 13])] < number:
                gone[a : a + 13] = [True] * 13
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        kept = b" ".join(w for w, g in zip(line, gone, strict=True) if not g)
        out.append((i, len(line), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3}, {"BLOCK_ROWS": 40, "CHUNK_BYTES": 100}])
def test_repeated_word_strings(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(seed_extend, name, value)
    rng = random.Random(5)
    base, passage = words(rng, 120, 300), words(rng, 40, 500)
    texts = [None, "", " ", "a b", "x " * 30, "a b " * 40, "y" * 300 + " z" * 20]
    for k in range(60):
        near = list(base)
        for _ in range(k % 7):
            near[rng.randrange(len(near))] = f"new{rng.randint(0, 3)}"
        texts.append(" ".join(near))
    texts += [" ".join(words(rng, rng.randint(0, 30), 900) + passage[rng.randint(0, 20) :] + words(rng, rng.randint(0, 30), 900)) for _ in range(60)]
    texts += [" ".join(words(rng, rng.randint(1, 90), 3)) for _ in range(30)]
    texts += [texts[-1]] * 3 + ["\n".join(texts[20].split())]
    rng.shuffle(texts)
    rows = [(i, t, i) for i, t in enumerate(texts)]
    # equal rows, one id with two texts, rows without id
    rows += [rows[40], (41, " ".join(base), 41), (3, " ".join(words(rng, 50, 9000)), 3), (None, " ".join(base[:60]), 10**9), (None, "only here " * 30, 10**9)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id bigint, text string, doc string, seed string").repartition(3)
    got = [tuple(r) for r in seed_extend.deduplicate(docs, with_kept=True).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants.group(docs).count() == 0 and seed_extend.deduplicate(docs).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id bigint, label int, vector array<int>"), F.lit(True)).count() == 0
