import hashlib
import random
import re

import pytest
from siftline.llm.fill_middle import LEAF, Sentinels, leaves, rearrange, restore, rope_of, split, text, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, t, seed=42, rate=50, spm=80):
    """The definition, on strings."""
    t = t or ""
    units = UNIT.findall(t)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", " \n\t ", "a", " a", "a ", "  a  b\t\nc  ", "é日本 ß　x \U0001f600y", "has <P> in it", "<S>", "x<M>", "ends with <", "<S <P <", "S> P> M>",
    "w " * 5000, " ".join(f"ü{i}" for i in range(3 * LEAF)), "x" * 100_000, " " * 5000, "\x1c a\x85b  c", "a\0b c",
]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_all_shapes(spark, rate, spm):
    rows = [(i + 100 * k, t, "o", 1) for k in range(6) for i, t in enumerate(TEXTS)] + [(None, "a b c d", "o", 1), (0, "twice here", "o", 1), (0, "twice here", "o", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    out = restore(rearrange(df, rate=rate, spm=spm))
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(r.doc_id, r.text, 42, rate, spm)
        assert r.restored == (r.text or "")
    assert restore(rearrange(df.limit(0))).collect() == []


def test_ropes_cut_anywhere():
    """Every cut of a rope, by units and by code points, at and inside units and leaves."""
    rnd = random.Random(3)
    for _ in range(30):
        t = "".join(rnd.choice(["a", "é", "日", " ", "\n", "😀"]) for _ in range(rnd.randrange(1, 1500)))
        import numpy as np

        data = np.frombuffer(t.encode(), np.uint8)
        ends, first = unit_ends(data, np.array([0, len(data)]))
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        units = UNIT.findall(t)
        assert first.tolist() == [0, len(units)]
        rope = rope_of(t.encode(), ends, points)
        assert (rope.units, rope.chars) == (len(units), len(t))
        assert all(x.units <= LEAF for x in leaves(rope))
        for rank in [0, len(units), *(rnd.randrange(len(units) + 1) for _ in range(20))]:
            a, b = split(rope, rank)
            assert (text(a).decode(), text(b).decode()) == ("".join(units[:rank]), "".join(units[rank:]))
            assert (a.units, b.units, a.chars + b.chars) == (rank, len(units) - rank, len(t))
        for rank in [0, len(t), *(rnd.randrange(len(t) + 1) for _ in range(20))]:
            a, b = split(rope, rank, "chars")
            assert (text(a).decode(), text(b).decode()) == (t[:rank], t[rank:])
            assert (a.chars, b.chars) == (rank, len(t) - rank)
            again = split(a, rank // 2, "chars")
            assert text(again[0]).decode() == t[: rank // 2]


def test_sentinels_that_cannot_be_told_apart(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for marks in (Sentinels("<P>", "<P>x", "<M>"), Sentinels("", "<S>", "<M>"), Sentinels("aba", "c", "d")):
        with pytest.raises(ValueError):
            rearrange(df, marks=marks)


def test_query_against_the_definition(spark):
    from siftline.llm.queries import op13_fill_middle

    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        *head, out = plain_form(r.doc_id, r.text)
        want[r.doc_id] = (*head, sha(out), sha(r.text or ""))
    assert {r.doc_id: tuple(r)[1:] for r in op13_fill_middle(spark, sf).collect()} == want
