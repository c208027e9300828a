import re
from collections import Counter

import numpy as np
import pytest
from siftline.llm.quality import RULES, fit, keep_good, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_small_cases(spark):
    texts = [None, "", " \n\n", "one", "a b c a b c", "a\n a\na\n\n\nb\t", "é ß\x0b日本 |#", "x y z " * 500, "\n".join(["same line"] * 40), " ".join(f"w{i}" for i in range(60)), "a\r\na\r\na", "\n", "w" * 9000]
    df = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(texts)] + [(None, "x", 5, True), (1, "", 5, True)], "doc_id long, text string, n_words int, kept boolean").repartition(2)
    got = score(df)
    assert got.columns == ["doc_id", "text", *BASE, "p_good", "kept"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert tuple(r[c] for c in BASE) == base(r.text), r
        assert not (r.kept and r.base_failed)
    assert score(df.limit(0)).collect() == []
    assert keep_good(df).columns == df.columns


@pytest.fixture(scope="module")
def judged(spark):
    from siftline.llm.queries import op7_weak_supervision

    got = {r.doc_id: r for r in op7_weak_supervision(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(tuple(got[i][c] for c in BASE) == base(t) for i, t in texts.items())
    return got


def test_verdicts_against_labels(spark, judged):
    """Labels are for this test alone; the model doesn't see them."""
    labels = [(judged[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if not judged[r.doc_id].base_failed]
    good, bad = [g.kept for g, q in labels if q], [g.kept for g, q in labels if not q]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.1


def test_estimates_accuracies():
    """Rules with known rates: EM finds them, and the posterior beats the majority."""
    rnd, k, n = np.random.default_rng(0), len(RULES), 40_000
    good = rnd.random(n) < 0.8
    if_good, if_bad = np.linspace(0.02, 0.45, k), np.linspace(0.95, 0.5, k)
    bad = rnd.random((n, k)) < np.where(good[:, None], if_good, if_bad)
    votes = np.where(rnd.random((n, k)) < 0.2, 0, np.where(bad, -1, 1))
    patterns = Counter(((votes + 1) @ (3 ** np.arange(k))).tolist())
    model = fit(patterns)
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(np.array(model.bad_if_good) - if_good).max() < 0.05
    assert np.mean((model.posterior(votes) >= 0.5) == good) >= np.mean((votes.sum(axis=1) >= 0) == good)
    assert 0 < fit({}).prior < 1
