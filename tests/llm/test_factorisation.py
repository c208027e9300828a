import zlib
from itertools import combinations

import numpy as np
import pytest
from siftline.llm import factorisation as M
from siftline.llm import kernels as K

SF = "/root/testdata/sf0.01"


def rows_of(texts, meta=()):
    data = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    return M.features(np.frombuffer(b"".join(data), np.uint8), off, [np.array(m, float) for m in meta])


def test_identity_equals_all_pairs():
    """Scores in linear time are those of the sum over all pairs of features."""
    rnd = np.random.default_rng(0)
    rows = rows_of(["a b c d a b", "", "one\none\nTWO!! 3", "x " * 50, " \n "], [[5, np.nan, 0, -3, 1e12]])
    m = M.Machine(0.3, rnd.normal(0, 0.3, M.size(1)), rnd.normal(0, 0.3, (M.size(1), M.FACTORS)))
    for i, got in enumerate(m.scores(rows)):
        part = slice(rows.first[i], rows.first[i + 1])
        f, x = rows.feature[part], rows.value[part].astype(float)
        total = m.bias + m.weight[f] @ x + sum(m.factor[f[a]] @ m.factor[f[b]] * x[a] * x[b] for a, b in combinations(range(len(f)), 2))
        assert got == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_features_do_not_depend_on_the_slice():
    texts = ["Grün ist\nder Baum.\nist\nist", None or "", "w " * 3000, "a\n\nb\n", "x"]
    together = rows_of(texts, [[1, 2, 3, 4, 5]])
    for i, t in enumerate(texts):
        alone = rows_of([t], [[i + 1]])
        part = slice(together.first[i], together.first[i + 1])
        assert together.feature[part].tolist() == alone.feature.tolist()
        assert np.allclose(together.value[part], alone.value)
    names = {n: k for k, (n, _) in enumerate(M.STATISTICS)}
    base = M.BUCKETS + sum(M._SIZES[: names["lines equal to an earlier one"]])
    hit = {i: [f - base for f in together.feature[together.first[i] : together.first[i + 1]] if base <= f < base + M._SIZES[names["lines equal to an earlier one"]]] for i in range(5)}
    assert hit == {0: [4], 1: [0], 2: [0], 3: [0], 4: [0]}  # one of four lines


def test_interactions_are_learned():
    """Class 1 if just one of two words is there: no linear model can tell."""
    texts = ["alpha beta gamma", "alpha gamma", "beta gamma", "gamma delta"] * 60
    good = np.array([False, True, True, False] * 60)
    rows = rows_of(texts)
    m = M.fit(rows, good, (120, 120), M.size(0))
    assert ((m.scores(rows) >= 0.5) == good).all()


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, None), (None, "c", 1), (1, "a b", 3)], "doc_id long, text string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (2, None), (1, 7), (9, 1)], "doc_id long, quality int")
    assert {r.score for r in M.score(docs, M.train(docs, none)).collect()} == {0.5}
    got = [r.score for r in M.score(docs, M.train(docs, ones)).collect()]
    assert len(got) == 4
    assert all(abs(x - 4 / 5) < 1e-6 for x in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, "5", 0.1, True) for i, t in enumerate(["good words here " * 20, "BAD!! BAD!! " * 20, None, "", " \n", "ü" * 50_000, "x y " * 9000, "good words here " * 20])] + [(None, "z", "no number", 0.2, False)],
        "doc_id long, text string, n_chars string, score double, place boolean",
    )
    labels = spark.createDataFrame([(0, 1, "k"), (1, 0, "k"), (1, 0, "k"), (7, 1, "k")], "doc_id long, quality long, text string")
    model = M.train(docs, labels)
    out = M.score(docs.repartition(3), model)
    assert out.columns == ["doc_id", "text", "n_chars", "place", "score"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == 9
    assert all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[7] > 0.5 > got[1]
    assert M.score(docs.limit(0), model).collect() == []
    assert M.score(docs.select("text"), model).columns == ["text", "score"]
    again = M.train(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(again.weight, model.weight)
    assert np.array_equal(again.factor, model.factor)


def test_held_out_accuracy(spark):
    from siftline.llm.queries import op11_factorisation_machine

    rows = op11_factorisation_machine(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    pairs = [(by[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if by[r.doc_id].held_out]
    good, bad = (np.array([s for s, q in pairs if q == c]) for c in (1, 0))
    assert len(good) > 80
    assert len(bad) > 10
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    accuracy = (np.sum(good >= 0.5) + np.sum(bad < 0.5)) / len(pairs)
    print(f"held out: {len(pairs)}, area under the curve {auc:.3f}, accuracy {accuracy:.3f}, good kept {(good >= 0.5).mean():.3f}, bad caught {(bad < 0.5).mean():.3f}")
    assert auc > 0.97
    assert accuracy > 0.95
