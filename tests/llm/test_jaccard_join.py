"""Components against all pairs, and the order of rounds against a plain union-find."""

import random
import re

import numpy as np
import pytest

from emberwatch.llm import jaccard_join as jj
from emberwatch.llm.graph import components


def plain_roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    roots = plain_roots(range(len(rows)), links)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[roots[i]] = min(least.get(roots[i], k), k)
    return sorted(((k, len(sets[i]), least.get(roots[i])) for i, (k, _) in enumerate(rows)), key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = plain_roots({x for e in real for x in e}, real)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.where("a > 9999")).count() == 0


@pytest.mark.parametrize("count_from", [1, 4])
def test_random_texts(spark, monkeypatch, count_from):
    monkeypatch.setattr(jj, "COUNT_FROM", count_from)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9))
    common = [word() for _ in range(12)]
    rows = [(None, None), (None, "A b"), (900, "a B"), (901, ""), (901, "x"), (902, "  "), (903, "É e"), (904, "é e")]
    for _ in range(14):
        base = [word() for _ in range(rng.randint(5, 80))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 4) :]
            rows.append((rng.randint(0, 300), " ".join(copy)))
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, c string")
    got = sorted((tuple(r) for r in jj.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    assert jj.near_duplicates(df.limit(0)).count() == 0


def test_frequent_shingles_ask_for_more_matches():
    rare, common = (jj.prefix_choice(np.full(300, f), 80) for f in (0, 5000))
    assert 1 <= rare < common <= jj.MOST_MATCHES


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in jj.query(spark, folder).collect()), key=repr) == brute(rows)


def test_words_that_weak_hashes_confuse(spark):
    """Thue-Morse words and their complements are equal for polynomial hashes modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    t, u = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    df = spark.createDataFrame([(1, f"{t} x y z"), (2, f"{u} x y z"), (3, f"{t} x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jj.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_marks_never_differ_more_than_sets():
    """Of sets of any sizes, by as many bits as both have; and they tell nearly all sets apart that are not near."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 5, 60, 200, 300, 900, 30000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (0, n // 50, n // 10, n // 7, n // 3, n)]
    marks = jj._Marks(np.array([jj.marks_of(x) for x in sets], object))
    x, y = (v.ravel() for v in np.indices((len(sets), len(sets))))
    least = marks.differ(x, y)
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    sizes = np.array([len(sets[i]) + len(sets[j]) for i, j in zip(x, y, strict=True)])
    assert (least <= apart).all() and not least[x == y].any()
    n = np.array([len(s) for s in sets])
    far = (9 * apart > 1.3 * sizes) & (np.minimum(x, y) >= 12) & (100 * np.minimum(n[x], n[y]) >= 80 * np.maximum(n[x], n[y]))
    assert far.sum() >= 90 and (9 * least > sizes)[far].all()


def test_groups_that_never_join_make_few_rows(spark, monkeypatch):
    """Copies of one text that are not quite near enough share prefix shingles, yet their pairs make no rows; those that link are found."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame, rows = [word() for _ in range(130)], []
    for k in range(60):
        own = list(frame)
        for at in rng.sample(range(18), 2):
            own[7 * at + 3] = word()
        rows.append((k, " ".join(own)))
    rows += [(200 + k, rows[k][1].rsplit(" ", 1)[0] + " " + word()) for k in range(3)]
    made, plain = [], jj._crossing

    def crossing(*x):
        made.append(plain(*x).count())
        return plain(*x)

    monkeypatch.setattr(jj, "_crossing", crossing)
    got = sorted((tuple(r) for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert len({w[2] for w in want}) > 20 and made[0] < 500, (len({w[2] for w in want}), made)


def test_groups_that_link_make_few_rows(spark, monkeypatch):
    """Nearly all pairs of a group of near copies link; a few of each class join it, so the others make no row."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame, rows = [word() for _ in range(300)], []
    for k in range(60):
        own = list(frame)
        for at in rng.sample(range(42), 3):
            own[7 * at + 3] = word()
        rows.append((k, " ".join(own)))
    made, plain = [], jj._crossing

    def crossing(*x):
        made.append(plain(*x).select("a", "b").distinct().count())
        return plain(*x)

    monkeypatch.setattr(jj, "_crossing", crossing)
    monkeypatch.setattr(jj, "TURNS", 0)
    got = sorted((tuple(r) for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows) and len({g[2] for g in got}) == 1
    assert sum(made) < 60 * 59 // 4, made
