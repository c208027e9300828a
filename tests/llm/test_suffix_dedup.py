import random
import re
from collections import defaultdict

import pytest
from siftline.llm.suffix_dedup import repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least=50):
    """Spans of words in windows that another doc_id has as well, by comparing all windows."""
    held, texts = defaultdict(set), {(i, t) for i, t in rows if i is not None and t is not None}
    for i, t in texts:
        w = WORD.findall(t)
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(i)
    out = []
    for i, t in texts:
        w, spans = WORD.findall(t), []
        for k in range(len(w) - least + 1):
            if len(held[tuple(w[k : k + least])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
        if spans:
            out.append((i, len(w), spans))
    return sorted(out)


def found(df):
    got = repeated_passages(df).collect()
    assert all(r.n_spans == len(r.spans) and r.n_repeated_words == sum(s.end - s.start for s in r.spans) for r in got)
    return sorted((r.doc_id, r.n_words, [[s.start, s.end] for s in r.spans]) for r in got)


def test_small_cases(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    fill = lambda n: [word() for _ in range(n)]
    p50, p49, p300 = fill(50), fill(49), fill(300)
    rows = [(1, None), (2, ""), (3, "few words"), (None, " ".join(p300))]
    rows += [(10, " ".join(fill(30) + p50 + fill(9))), (11, " ".join(p50) + "\n\t" + " ".join(fill(40)))]
    rows += [(12, " ".join(fill(30) + p49 + fill(9))), (13, " ".join(fill(3) + p49 + fill(40)))]  # one word short
    rows += [(20, " ".join(p300)), (21, " ".join(p300)), (22, " ".join(fill(60) + p300[40:220] + fill(70))), (23, " ".join(p300[:90]))]
    rows += [(30, " ".join(p50 + fill(60) + p50)), (31, "x " * 400), (32, "y " * 30 + "x " * 70), (33, " ".join(["z q"] * 200))]  # repeats of few words
    rows += [(40, " ".join(fill(70))), (40, " ".join(fill(70) + p49)), (41, " ".join(fill(60) * 3))]  # repeats within one id
    rows += [(21, " ".join(p300)), (50, " ".join(fill(20_000) + p300[100:160]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_of_few_words(spark, seed):
    """A small vocabulary and shared pieces of all lengths around the bound."""
    rnd = random.Random(seed)
    pool = [[f"v{rnd.randrange(40)}" for _ in range(rnd.randrange(40, 75))] for _ in range(12)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            t += rnd.choice(pool)[rnd.randrange(4) :] + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
        rows.append((i, " ".join(t)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_against_all_windows(spark):
    from siftline.llm.queries import op9_sparse_suffixes

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op9_sparse_suffixes(spark, "/root/testdata/sf0.01").collect()
    spans = lambda text: [[int(x) for x in s.split("-")] for s in text.split(",")]
    assert sorted((r.doc_id, r.n_words, spans(r.spans)) for r in got) == brute(rows)
