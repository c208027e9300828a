import random
import re

import numpy as np
import pytest
from siftline.llm import kernels as K
from siftline.llm.decontaminate import LITERAL, NAME, NUMBER, UNIT, compare, decontaminate, leaks, same_words, template

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kinds(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return template(data, np.array([0, len(data)]))[1].tolist()


def test_kinds():
    assert kinds("Then Anna paid 12.50 euros, and É. Bob got 3 kg. Kg is kg; Élan") == [LITERAL, NAME, LITERAL, NUMBER, UNIT, LITERAL, NAME, LITERAL, LITERAL, NUMBER, UNIT, LITERAL, LITERAL, LITERAL, LITERAL]
    assert kinds("") == kinds(" \n") == []
    assert kinds("| ### 5km x\nAnna") == [LITERAL, LITERAL, NUMBER, LITERAL, LITERAL]


ITEM = "A train leaves the station with Anna at 12 o'clock and runs 80 km per hour for 3 hours; how far does Anna get by then in total?"


def test_slots():
    assert compare("x " * 50 + ITEM + " y" * 50, ITEM)["kind"] == "verbatim"
    assert compare(ITEM.lower(), ITEM) is None  # without capitals there are no names
    changed = ITEM.replace("Anna", "Boris").replace("80", "95").replace("12", "9").replace("km", "miles")
    got = compare("Some words before. " + changed, ITEM)
    assert got["kind"] == "reparameterised" and got["n_changed"] == 4
    assert compare(changed.replace("Boris", "Clara", 1), ITEM) is None  # one name became two
    assert compare(" ".join(ITEM.split()[:12]), ITEM) is None
    assert compare("", ITEM) is None and compare(ITEM, "") is None


def test_small_cases(spark):
    rnd = random.Random(2)
    fill = lambda n: " ".join(f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}x" for _ in range(n))
    changed = ITEM.replace("Anna", "Boris").replace("80", "95")
    rows = [(1, ITEM), (2, f"{fill(40)} {ITEM}\n{fill(20)}"), (3, changed), (4, fill(80)), (5, None), (6, ""), (None, ITEM), (7, "what is this"), (8, "What, is this?"), (2, "same id, other text"), (1, ITEM), (9, fill(30_000) + " " + changed), (10, (ITEM + " ") * 3)]
    bench = spark.createDataFrame([(1, ITEM, 5), (2, "What is this", 5), (3, None, 5), (4, "", 5), (5, "1 2 3 4 5 6", 5), (None, "few words", 5), (1, ITEM, 5)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kind string, item_id int").repartition(3)
    want = sorted([(1, 1, "verbatim"), (2, 1, "verbatim"), (3, 1, "reparameterised"), (None, 1, "verbatim"), (7, 2, "verbatim"), (8, 2, "verbatim"), (9, 1, "reparameterised"), (10, 1, "verbatim")], key=str)
    for filtered in (1000, 3):  # with the broadcast filter, and without
        assert sorted(((r.doc_id, r.item_id, r.kind) for r in leaks(docs, bench, filtered).collect()), key=str) == want
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in clean.collect()) == sorted((i, (t or "")[:9]) for i, t in [rows[3], rows[4], rows[5], rows[9]])
    assert leaks(docs.limit(0), bench).collect() == leaks(docs, bench.limit(0)).collect() == []


def plain_windows(text):
    """Windows of five words in lower case without outer punctuation, by regular expression."""
    words = [w.strip("!\"'()*,-./:;<=>?[\\]^_`{|}~") or w for w in WORD.findall((text or "").lower().replace("ß", "ss").replace("ς", "σ"))]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def holds_words(text, item):
    own = plain_windows(item)
    return bool(own) and 4 * len(own & plain_windows(text)) >= 3 * len(own)


@pytest.mark.parametrize("case", [str, str.lower, str.upper, str.title])
def test_items_in_any_case(spark, case):
    """Each item of the benchmark within other words, as it is and in other capitals."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rows = [(i, f"some words that stand before\n{case(t)}\nand others behind it") for i, t in items.items()]
    rows.append((-1, "some words that stand before\nand others behind it"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got >= {(i, i) for i in items} and len(items) == 40
    assert got >= {(d, i) for d, t in rows for i in items if holds_words(t, items[i])} and not any(d == -1 for d, _ in got)
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {-1}


def test_items_without_plain_words(spark):
    """Numbers and names alone, letters outside Latin-1, and a short item."""
    bench = spark.createDataFrame([(1, "1 2 3 4 5 6"), (2, "Anna Boris Clara Dora Emil Fritz"), (3, "ВОЛГА ВПАДАЕТ В КАСПИЙСКОЕ МОРЕ"), (4, "Yes"), (5, ""), (6, None)], "item_id long, text string")
    rows = [(1, "x 1, 2, 3, 4, 5, 6 y"), (2, "x ANNA BORIS CLARA DORA EMIL FRITZ y"), (3, "x Волга впадает в Каспийское море."), (4, "YES!"), (5, "yes x"), (6, "1 2 3 5 4 6"), (7, ""), (8, None), (9, "Anna Boris Clara")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for filtered in (1000, 1):
        assert sorted((r.doc_id, r.item_id, r.kind) for r in leaks(docs, bench, filtered).collect()) == [(k, k, "verbatim") for k in (1, 2, 3, 4)]
    assert same_words("", "a") is None and same_words("a", "") is None and same_words("A", "a")["n_windows"] == 1


def test_against_all_pairs(spark):
    from siftline.llm.queries import op3_templates

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    five = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall(t)] for k in range(len(w) - 4)}
    own = {i: five(t) for i, t in items.items()}
    exact, want = set(), set()
    for d, t in docs.items():
        mine = five(t)
        for i, s in own.items():
            if 4 * len(s & mine) >= 3 * len(s):
                exact.add((d, i))
            if len(s & mine) and compare(t, items[i]):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in op3_templates(spark, sf).collect()}
    assert got >= exact and len(exact) > 5
    plain = {(d, i) for d, t in docs.items() for i in items if holds_words(t, items[i])}
    assert got >= want | plain and all((d, i) in plain or compare(docs[d], items[i]) for d, i in got)
