"""Quality rules as weak supervision.

Each rule votes good or bad, or abstains. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes bad on good and on bad documents, without labels; a document is kept
if the posterior probability that it is good is at least one half."""

from __future__ import annotations

from collections import Counter
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
from .tokenization import release

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;")] = True

#: Rules: votes bad at or beyond the first bound, good at or below the second, else abstains; below
#: ``words`` words it abstains always.
RULES = (
    ("symbols a word", 0.10, 0.02, 20),
    ("share of repeated words", 0.30, 0.10, 20),
    ("share of repeated lines", 0.30, 0.05, 20),
    ("mean word length", 8.0, 6.0, 20),
    ("share of capitals", 0.30, 0.08, 20),
    ("share of known words", 0.65, 0.45, 50),
    ("share of other characters", 0.25, 0.08, 20),
    ("words that end with a mark, away from 0.1", 0.30, 0.12, 50),
)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])


def features(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Exact base counts of each text, and the matrix of votes (1 good, -1 bad, 0 none)."""
    docs = len(off) - 1
    start, end, first = K.words(data, off)
    n = np.diff(first)
    solid = ~K._WS[data]
    code_point = (data & 0xC0) != 0x80
    chars = _per_text(solid & code_point, off)
    symbols = _per_text(_SYMBOL[data], off)

    # Lines: a text has one more than it has line ends.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((off[:-1], breaks + 1)))
    owner = np.concatenate((np.arange(docs), np.searchsorted(off, breaks, "right") - 1))
    owner = np.sort(owner)
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    line_end[-1:] = len(data)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    line_end[last] = off[owner[last] + 1]
    count = np.concatenate(([0], np.cumsum(solid)))
    worded = count[line_end] > count[line_start]
    lines = (owner[worded].astype(K.U64) << K.U64(52)) | (K.span_hashes(data, line_start[worded], line_end[worded]) >> K.U64(12))
    n_lines = np.bincount(owner[worded], minlength=docs)
    dup_lines = n_lines - np.bincount((np.unique(lines) >> K.U64(52)).astype(np.int64), minlength=docs)

    hashes = K.span_hashes(data, start, end)
    doc = np.repeat(np.arange(docs), n)
    three, whole = K.windows(hashes, first, 3)
    at = np.flatnonzero(whole)
    key = (doc[at].astype(K.U64) << K.U64(52)) | (three[at] >> K.U64(12))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[at[order[again]] + j] = True
    repeated = _per_text(covered, first)

    distinct = np.bincount((np.unique((doc.astype(K.U64) << K.U64(52)) | (hashes >> K.U64(12))) >> K.U64(52)).astype(np.int64), minlength=docs)
    capitals = _per_text(_UPPER[data], off)
    letters = _per_text(_LETTER[data], off)
    marks = _per_text(_END[data[end - 1]] if len(end) else np.zeros(0, bool), first)
    one = np.maximum(n, 1)
    values = (
        symbols / one,
        repeated / one,
        dup_lines / np.maximum(n_lines, 1),
        chars / one,
        capitals / np.maximum(letters, 1),
        1 - distinct / one,
        1 - letters / np.maximum(chars, 1),
        np.abs(marks / one - 0.1),
    )
    votes = np.zeros((docs, len(RULES)), np.int8)
    for j, (value, (_, bad, good, least)) in enumerate(zip(values, RULES, strict=True)):
        votes[:, j] = np.where(n < least, 0, np.where(value >= bad, -1, np.where(value <= good, 1, 0)))
    failed = (n < 50) | (100 * repeated > 50 * n)
    base = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": failed}
    return base, votes


def _pattern(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1]))


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. bad_if_good, bad_if_bad: how often each rule that votes, votes bad."""

    prior: float
    bad_if_good: tuple[float, ...]
    bad_if_bad: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are good; the prior where all rules abstain."""
        g, b = np.array(self.bad_if_good), np.array(self.bad_if_bad)
        log = np.log(self.prior / (1 - self.prior)) + (votes < 0) @ np.log(g / b) + (votes > 0) @ np.log((1 - g) / (1 - b))
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))


def fit(patterns: dict[int, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from the number of documents of each vote pattern.

    Starts from the view that a document is bad if any rule says so: bad documents differ in what is wrong
    with them, so that for most of them most rules vote good. Rates stay in 0.01 to 0.99 and each has one document of each kind
    added, so that a rule that never votes, or no documents at all, give a defined model."""
    k = len(RULES)
    votes = np.array([[p // 3**j % 3 - 1 for j in range(k)] for p in patterns], np.int8).reshape(-1, k)
    n = np.array(list(patterns.values()), float)
    good = np.where((votes < 0).any(axis=1), 0.1, 0.95)
    model = None
    for _ in range(rounds):
        rate = lambda w: tuple(np.clip((((votes < 0) * w[:, None]).sum(axis=0) + 1) / (((votes != 0) * w[:, None]).sum(axis=0) + 2), 0.01, 0.99).tolist())  # noqa: B023, E731
        found = LabelModel(float(np.clip(((n * good).sum() + 1) / (n.sum() + 2), 0.01, 0.99)), rate(n * good), rate(n * (1 - good)))
        good = found.posterior(votes)
        if model and max(abs(a - b) for a, b in zip((found.prior, *found.bad_if_good, *found.bad_if_bad), (model.prior, *model.bad_if_good, *model.bad_if_bad), strict=True)) < 1e-9:
            break
        model = found
    return found


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    seen: Counter = Counter()
    for batch in batches:
        for _, _, data, off in K.texts(batch.column(0)):
            base, votes = features(data, off)
            p, c = np.unique(_pattern(votes[~base["base_failed"]]), return_counts=True)
            seen.update(dict(zip(p.tolist(), c.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def train(docs: DataFrame) -> LabelModel:
    """The model for ``docs`` (text), from all rows that pass the base rules. Only counts of vote patterns reach the driver: at most three to
    the power of the number of rules, whatever the number of documents. Null counts as the empty text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return fit({r.pattern: r.n for r in rows.orderBy("pattern").collect()})


def _judged(text: pa.Array, model: LabelModel) -> list[pa.Array]:
    parts = []
    for _, _, data, off in K.texts(text):
        base, votes = features(data, off)
        p = model.posterior(votes)
        parts.append([*base.values(), p, ~base["base_failed"] & (p >= 0.5)])
    return [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else []


def _score(batches: Iterator[pa.RecordBatch], model: LabelModel, text: int, keep: list[int], only_kept: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        if not len(batch):
            continue
        judged = _judged(batch.column(text), model)
        columns = [batch.column(i) for i in keep] + ([] if only_kept else judged)
        out = pa.RecordBatch.from_arrays(columns, names)
        yield out.filter(judged[-1]) if only_kept else out


def score(docs: DataFrame, model: LabelModel | None = None) -> DataFrame:
    """Adds to each row of ``docs`` (text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, p_good, kept.

    base_failed: under 50 words, or more than half of the words in 3-word windows that occur twice or more.
    kept: not base_failed, and the posterior p_good is at least 0.5. Null counts as the empty text. Columns
    of these names that docs has already are replaced; rows may repeat; an empty table gives no rows."""
    prepare(docs.sparkSession)
    model = model or train(docs)
    made = [c.split()[0] for c in f"{FEATURES}, p_good double, kept boolean".split(", ")]
    docs = docs.select([c for c in docs.columns if c not in made])
    schema = StructType([*docs.schema, *StructType.fromDDL(f"{FEATURES}, p_good double, kept boolean")])
    run = partial(_score, model=model, text=docs.columns.index("text"), keep=list(range(len(docs.columns))), only_kept=False, names=[*docs.columns, *made])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: LabelModel | None = None) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with their own columns only; no shuffle."""
    prepare(docs.sparkSession)
    model = model or train(docs)
    run = partial(_score, model=model, text=docs.columns.index("text"), keep=list(range(len(docs.columns))), only_kept=True, names=docs.columns)
    return docs.mapInArrow(run, docs.schema)
