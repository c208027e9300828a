"""Stages of the pipeline on odd tables: nulls in any column, empty and very long texts, repeated rows, other columns, no rows."""

import random
import re

import corpus_pipeline as P
import pytest

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    lines = []
    while n > 0:
        k = min(n, r.randint(6, 14))
        lines.append(" ".join(r.choice(words) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(lines)


def odd(spark):
    long_ = prose(1, 60_000)
    twice = (5, prose(5, 120), "en", "s", 700)
    rows = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \n\t\n", "en", None, 4),
        (4, long_, None, "s", len(long_)),
        twice,
        twice,
        (None, prose(7, 120), "en", "s", 700),
        (8, prose(8, 120), None, None, None),
        (9, "\x00   \U0001f600 " + prose(9, 120), "xx", "s", 1),
    ]
    return spark.createDataFrame(rows, DDL)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def clashing(df):
    """The table with columns of names that the operators use themselves."""
    extra = "kept removed n_removed component_id node t1 bucket n_words p_good item_id emptied ids".split()
    return df.selectExpr("*", *(f"'x' AS {c}" for c in extra))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_no_rows(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], DDL), SF)
    assert out.collect() == []
    assert name == P.STAGES[-1][0] or out.columns == P.COLUMNS


@pytest.mark.parametrize("name,stage", P.STAGES[1:])
def test_odd_rows_stay(spark, name, stage):
    """Stages that look for copies leave odd rows alone; repeated rows are one document, of which both rows stay or one's lines go."""
    docs = odd(spark)
    out = stage(spark, clashing(docs), SF)
    assert name == P.STAGES[-1][0] or out.columns == P.COLUMNS
    assert ids(out) == ids(docs)
    if name != P.STAGES[-1][0]:
        key = lambda r: (str(r.doc_id), r.text or "")
        assert sorted(out.select("doc_id", "text").collect(), key=key) == sorted(docs.select("doc_id", "text").collect(), key=key)


def test_quality_of_odd_rows(spark):
    """What has no 50 words goes; long and odd texts do not fail."""
    got = ids(P.quality_rules(spark, clashing(odd(spark)), SF))
    assert not {1, 2, 3} & set(got)
    assert got.count(5) in (0, 2)  # equal rows are judged alike


def test_near_duplicates_against_all_pairs(spark):
    """The stage on documents without equal lines removed, against the definition: one of each component stays."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids(P.near_dedup(spark, docs, SF)) == sorted((i for i in sets if root(i) == i), key=str)
    assert len({root(i) for i in sets}) < len(sets)


def test_lines_that_go(spark):
    """Of a line that two documents have the first stays; a document whose last word goes, goes; n_chars follows the text."""
    a, b, c = prose(20, 60), prose(21, 60), prose(22, 60)
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, f"{b}\n{a}", "en", "s", 1), (4, c, None, None, None)], DDL)
    got = {r.doc_id: (r.text, r.n_chars) for r in P.line_dedup(spark, docs, SF).collect()}
    assert got == {1: (a, 1), 3: (b, len(b)), 4: (c, None)}


def test_benchmark_items_go(spark):
    """A document that holds an item goes, whatever the case of its letters; others stay."""
    items = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    clean = [(i, prose(100 + i, 80), "en", "s", 1) for i in range(5)]
    held = [(100 + k, prose(200 + k, 40) + "\n" + f(r.text) + "\n" + prose(300 + k, 40), None, "s", 1) for k, (r, f) in enumerate((r, f) for r in items for f in (str, str.upper, str.lower))]
    docs = spark.createDataFrame(clean + held, DDL)
    assert ids(P.benchmark_decontamination(spark, docs, SF)) == [0, 1, 2, 3, 4]
