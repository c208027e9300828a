import numpy as np
import pyarrow as pa
from siftline.llm import kernels as K
from siftline.llm import quality


def thue_morse(a, b, n):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def test_texts_that_collide_under_every_polynomial_do_not_here():
    for n in (64, 1024, 4096):
        data, off = arrays([thue_morse("a", "b", n), thue_morse("b", "a", n)])
        h = K.span_hashes(data, off[:-1], off[1:])
        assert h[0] != h[1]
    words = [thue_morse("a", "b", 2048).replace("a", "x ").replace("b", "y "), thue_morse("b", "a", 2048).replace("a", "x ").replace("b", "y ")]
    data, off = arrays(words)
    start, end, first = K.words(data, off)
    h = K.span_hashes(data, start, end)
    whole, _ = K.windows(h, first, 2048)
    assert whole[first[0]] != whole[first[1]]
    assert len(set(K.sequences(h, first).tolist())) == 2


def test_lines_that_a_polynomial_takes_for_equal_are_no_duplicates():
    a, b = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    base, _ = quality.features(*arrays([f"{a}\n{b}", f"{a}\n{a}"]))
    assert base["n_dup_lines"].tolist() == [0, 1]


def test_fingerprints_depend_on_bytes_alone():
    rng = np.random.default_rng(1)
    for _ in range(100):
        words = [bytes(rng.integers(33, 126, rng.integers(0, 90))) for _ in range(6)]
        words[3] = words[0]
        off = np.cumsum([0] + [len(w) + 1 for w in words])
        h = K.span_hashes(np.frombuffer(b" ".join(words), np.uint8), off[:-1], off[1:] - 1)
        alone = [K.span_hashes(np.frombuffer(w or b" ", np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
        assert h.tolist() == [int(x) for x in alone]
        assert len(set(h.tolist())) == len(set(words))


def test_windows_are_those_of_the_sequence():
    h = K.mix(np.arange(1, 60, dtype=K.U64))
    h[40:60] = h[10:29][: len(h[40:60])]
    first = np.array([0, len(h)])
    for k in (1, 2, 3, 5, 7, 19):
        fp, whole = K.windows(h, first, k)
        assert whole.tolist() == [i + k <= len(h) for i in range(len(h))]
        for i in range(len(h) - k + 1):
            for j in range(len(h) - k + 1):
                assert (fp[i] == fp[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())


def test_slices_cover_all_texts():
    column = pa.array(["x" * n for n in (0, 5, 300_000, 1, 2, 200_000)] + [None, ""])
    seen = []
    for a, b, data, off in K.texts(column):
        seen += list(range(a, b))
        assert np.diff(off).tolist() == [len(t or "") for t in column.slice(a, b - a).to_pylist()] and len(data) == off[-1]
    assert seen == list(range(8))
