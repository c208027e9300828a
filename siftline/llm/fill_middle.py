"""Fill-in-the-middle by ropes.

A text is a rope: a balanced tree whose leaves are pieces of the text and whose nodes cache the units (words
with the white space before them) and code points below. A cut at a unit's rank walks down from the root and cuts
one leaf; everything else of the tree is shared by both sides. The rearranged text is a concatenation of
subtrees and sentinels, and the inverse cuts the output's rope at its sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .tables import prepare

#: Units of a leaf at most.
LEAF = 256


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True, slots=True)
class Leaf:
    """data: UTF-8 bytes; ends: where each of the units ends in them; chars: code points."""

    data: bytes
    ends: np.ndarray
    chars: int

    @property
    def units(self) -> int:
        return len(self.ends)

    def at_unit(self, rank: int) -> tuple[Rope, Rope]:
        cut = int(self.ends[rank - 1])
        left = self.data[:cut]
        n = _chars(left)
        return Leaf(left, self.ends[:rank], n), Leaf(self.data[cut:], self.ends[rank:] - cut, self.chars - n)

    def at_char(self, rank: int) -> tuple[Rope, Rope]:
        """Cuts at a code point; a unit that is cut ends on both sides."""
        starts = np.flatnonzero((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)
        cut = int(starts[rank])
        k = int(np.searchsorted(self.ends, cut, "left"))
        left = np.append(self.ends[:k], cut)
        right = self.ends[k + 1 :] if self.ends[k] == cut else self.ends[k:]
        return Leaf(self.data[:cut], left, rank), Leaf(self.data[cut:], right - cut, self.chars - rank)


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int


Rope = Leaf | Node
_NONE = np.zeros(0, np.int64)
EMPTY = Leaf(b"", _NONE, 0)


def _chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def concat(a: Rope, b: Rope) -> Rope:
    """Both ropes in one, without looking into either."""
    if not a.chars:
        return b
    return Node(a, b, a.units + b.units, a.chars + b.chars) if b.chars else a


def _tree(leaves: list[Leaf]) -> Rope:
    """A balanced tree over leaves in their order."""
    level: list[Rope] = leaves or [EMPTY]
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The rope before and from a rank of units or chars on; the path to the cut is rebuilt, the rest is shared."""
    before: list[Rope] = []
    after: list[Rope] = []
    while True:
        if rank <= 0:
            left, right = EMPTY, rope
        elif rank >= getattr(rope, by):
            left, right = rope, EMPTY
        elif isinstance(rope, Node):
            n = getattr(rope.left, by)
            if rank < n:
                after.append(rope.right)
                rope = rope.left
            else:
                before.append(rope.left)
                rope, rank = rope.right, rank - n
            continue
        else:
            left, right = rope.at_unit(rank) if by == "units" else rope.at_char(rank)
        for x in reversed(before):
            left = concat(x, left)
        for x in reversed(after):
            right = concat(right, x)
        return left, right


def leaves(rope: Rope) -> Iterator[Leaf]:
    todo = [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            yield x
        else:
            todo += [x.right, x.left]


def text(rope: Rope) -> bytes:
    return b"".join(x.data for x in leaves(rope))


def unit_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit ends (bytes from the start of the slice), and the first unit of each text (one more than texts).

    Units are words with the white space before them; white space at the end of a text, or alone, is one more."""
    _, end, first = K.words(data, off)
    n = np.diff(first)
    last = np.where(n > 0, end[np.maximum(first[1:] - 1, 0)] if len(end) else 0, off[:-1])
    tail = off[1:] > last
    at = np.cumsum(n + tail)
    out = np.insert(end, first[1:][tail], off[1:][tail])
    return out, np.concatenate(([0], at))


def rope_of(data: bytes, ends: np.ndarray, code_points: np.ndarray) -> Rope:
    """The rope of a text. ends: of its units; code_points: how many code points start before each byte, and in all."""
    cuts = ends[LEAF - 1 :: LEAF]
    cuts = np.append(cuts, len(data)) if not len(cuts) or cuts[-1] < len(data) else cuts
    out, a, first = [], 0, 0
    for b in cuts.tolist():
        last = min(first + LEAF, len(ends))
        out.append(Leaf(data[a:b], ends[first:last] - a, int(code_points[b] - code_points[a])))
        a, first = b, last
    return _tree(out) if data else EMPTY


def _sentinel(mark: str) -> Leaf:
    data = mark.encode()
    return Leaf(data, np.array([len(data)]), len(mark))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(rope: Rope, low: int, high: int, form: str, marks: Sentinels) -> tuple[Rope, int, int]:
    """The output's rope, and the code points of prefix and middle; low and high: ranks where they end."""
    prefix, rest = split(rope, low)
    middle, suffix = split(rest, high - low)
    p, s, m = (_sentinel(x) for x in marks.all())
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out: Rope = EMPTY
    for x in parts:
        out = concat(out, x)
    return out, prefix.chars, middle.chars


def restored(rope: Rope, form: str, places: tuple[int, int], marks: Sentinels) -> Rope:
    """The text's rope from the output's; places: code points before the second and third sentinel."""
    sizes = [len(x) for x in ((marks.suffix, marks.prefix, marks.middle) if form == "spm" else marks.all())]
    rest, three = split(rope, places[1], "chars")
    one, two = split(rest, places[0], "chars")
    first, second, middle = (split(x, n, "chars")[1] for x, n in zip((one, two, three), sizes, strict=True))
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return concat(concat(prefix, middle), suffix)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first row, row after the last, bytes, offsets, ends of units, first unit of each, code points before each byte."""
    for a, b, data, off in K.texts(column):
        ends, first = unit_ends(data, off)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        yield a, b, data.tobytes(), off, ends, first, points


def _forward(batches: Iterator[pa.RecordBatch], text_at: int, id_at: int, keep: list[int], seed: int, rate: int, spm: int, marks: Sentinels, names: list[str]) -> Iterator[pa.RecordBatch]:
    bad = [x.encode() for x in marks.all()]
    for batch in batches:
        for a, b, data, off, ends, first, points in _slices(batch.column(text_at)):
            ids = batch.column(id_at).slice(a, b - a).to_pylist()
            forms, prefixes, middles, outputs = [], [], [], []
            for i, doc_id in enumerate(ids):
                s, e = int(off[i]), int(off[i + 1])
                own, n = data[s:e], int(first[i + 1] - first[i])
                h = _draws(doc_id, seed)
                if not own or h[2] % 100 >= rate or any(x in own for x in bad):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(own)
                    continue
                form = "spm" if h[3] % 100 < spm else "psm"
                cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                rope = rope_of(own, ends[first[i] : first[i + 1]] - s, points[s : e + 1])
                out, p, m = rearranged(rope, *cuts, form, marks)
                forms.append(form)
                prefixes.append(p)
                middles.append(m)
                outputs.append(text(out))
            made = [pa.array(np.diff(first)), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
            made.append(pa.array(outputs, pa.binary()).view(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in keep] + made, names)


def _backward(batches: Iterator[pa.RecordBatch], output: int, form: int, keep: list[int], marks: Sentinels, names: list[str]) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in marks.all())
    for batch in batches:
        for a, b, data, off, ends, first, points in _slices(batch.column(output)):
            out = []
            for i, kind in enumerate(batch.column(form).slice(a, b - a).to_pylist()):
                begin, end = int(off[i]), int(off[i + 1])
                own = data[begin:end]
                if kind != "plain":
                    second = own.find(p if kind == "spm" else s)
                    third = own.find(m)
                    places = int(points[begin + second] - points[begin]), int(points[begin + third] - points[begin])
                    rope = rope_of(own, ends[first[i] : first[i + 1]] - begin, points[begin : end + 1])
                    own = text(restored(rope, kind, places, marks))
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in keep] + [pa.array(out, pa.binary()).view(pa.string())], names)


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def rearrange(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: Sentinels = Sentinels()) -> DataFrame:  # noqa: B008
    """Each row of ``docs`` (doc_id, text) with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The draws are the first four 32-bit groups of SHA-256 of ``seed:doc_id`` (nothing after the colon for a null
    doc_id, so rows that share an id share the draws). Of texts, ``rate`` in a hundred are rearranged, of those ``spm`` in a hundred with the
    suffix first. Empty and null texts, and texts that hold a sentinel, stay plain: output is the text (empty for null), both lengths are null.
    Prefix, middle or suffix may be empty, their sentinels stand all the same. Columns of the made names are
    replaced, others kept; an empty table gives no rows. No shuffle."""
    prepare(docs.sparkSession)
    if any(x in y for x in marks.all() for y in marks.all() if x is not y) or not all(marks.all()) or any({*x[1:]} & {y[0] for y in marks.all()} for x in marks.all()):
        raise ValueError("sentinels must differ, and none may begin inside another")
    made = [c.split()[0] for c in MADE.split(", ")]
    docs = docs.select([c for c in docs.columns if c not in made])
    docs = docs.withColumn("text", F.col("text").cast("string")) if dict(docs.dtypes)["text"] != "string" else docs
    run = partial(
        _forward, text_at=docs.columns.index("text"), id_at=docs.columns.index("doc_id"), keep=list(range(len(docs.columns))),
        seed=seed, rate=rate, spm=spm, marks=marks, names=[*docs.columns, *made],
    )
    return docs.mapInArrow(run, StructType([*docs.schema, *StructType.fromDDL(MADE)]))


def restore(rows: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:  # noqa: B008
    """Adds ``restored`` to rows with output and form: the text that ``rearrange`` was given. Null outputs count as empty."""
    prepare(rows.sparkSession)
    rows = rows.select([c for c in rows.columns if c != "restored"])
    run = partial(_backward, output=rows.columns.index("output"), form=rows.columns.index("form"), keep=list(range(len(rows.columns))), marks=marks, names=[*rows.columns, "restored"])
    return rows.mapInArrow(run, StructType([*rows.schema, *StructType.fromDDL("restored string")]))
