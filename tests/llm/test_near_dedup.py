import re

import pytest
from siftline.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i) if i is not None else None) for i, s in sets if i is not None)


def words(n, seed=0):
    return [f"w{(k * 7919 + seed * 104729) % 100003}" for k in range(n)]


def test_small_cases(spark):
    base = words(200)
    chain = [" ".join([*base[:k], *(f"x{k}_{j}" for j in range(4)), *base[k + 4 :]]) for k in range(5, 190, 12)]
    rows = [(9, "one two"), (3, "ONE  two\n"), (4, "one two three"), (1, None), (2, ""), (5, " \n\t"), (6, "é É"), (7, "É é"), (None, "one two"), (8, "x " * 3000)]
    rows += [(100 + i, t) for i, t in enumerate(chain)] + [(300, " ".join(words(5000, 2))), (301, " ".join(words(5000, 2)[:4000]))]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_shingles int, node string")
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_against_all_pairs(spark):
    from siftline.llm.queries import op10_superminhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op10_superminhash(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_family_of_near_copies(spark, seed):
    """Many near copies of one text, whose links to each other differ widely."""
    import random

    rnd, base = random.Random(seed), words(120, seed)
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rnd.randrange(8)):
            t[rnd.randrange(len(t))] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_families_that_drift(spark, seed):
    """Each copy is made from an earlier one, so that copies far from the hub are linked with each other."""
    import random

    rnd, texts = random.Random(seed), [words(100, seed)]
    while len(texts) < 150:
        t = list(rnd.choice(texts))
        for _ in range(rnd.randrange(1, 5)):
            t[rnd.randrange(len(t))] = f"z{rnd.randrange(10**6)}"
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()) == brute(rows)
