"""Subword encoding by distinct chunks.

A text is cut where the tokenizer is bound to cut it, each distinct chunk is encoded once by the
tokenizer's own library and kept in the worker, and ids are joined back by position. A chunk table is bounded
by ``TABLE_BYTES``, lives as long as the Python worker and goes when the worker turns to other texts' tables
(``load``) or to work without one (``release``)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Bytes of a worker's chunk table at most, and of an entry: its key, its ids and its place in the table.
TABLE_BYTES, ENTRY_BYTES = 160_000_000, 200

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space after a space: a run in which a byte-level pre-tokenizer may cut elsewhere than at the space.
_RUN = re.compile(" [\\s᠎]")
_LONE_SPACE = re.compile("(?<![\\s᠎]) (?![\\s᠎])")
#: Chunks that the library gets joined in one text.
JOINED = 512

#: A Latin word with one mark behind it, which the byte-level pattern always cuts off.
_MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)[.,]")

#: Before a text's first chunk, so that its table entry is not that of the same chunk after a space.
_FIRST = " \x00"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def file_digest(path: str) -> str:
    """The tokenizer's version: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Table:
    """Chunks with their ids, in two generations: when the young one is full it becomes the old one, from which chunks
    that are met again come back. So frequent chunks are encoded once, however many others pass by."""

    def __init__(self) -> None:
        self.chunks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _turn(self) -> None:
        if len(self.chunks) * ENTRY_BYTES * 2 > TABLE_BYTES:
            self.before, self.chunks = self.chunks, {}

    def _recalled(self, new: set[str]) -> set[str]:
        """The chunks of ``new`` that the old generation does not hold; the others come back."""
        if not self.before:
            return new
        known = [c for c in new if c in self.before]
        self.chunks.update([(c, self.before[c]) for c in known])
        return new.difference(known)


class ByteLevelBPE(_Table):
    """Ids of the tokenizers library for a byte-level BPE file (.json), as little-endian 32-bit integers.

    Cut at single spaces: the byte-level pattern starts a token at every space that has no white space
    beside it, whatever else is in the text, so the parts encode as they do in the whole. Texts with longer
    runs of white space are cut at their lone spaces only. Files with another pre-tokenizer or a
    normaliser are encoded text by text.

    New chunks go to the library joined: a chunk without inner spaces has one token that begins with a
    space, its first, so the ids fall apart again at these tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec.get("normalizer")
        self.by_chunk &= not spec.get("truncation") and not spec.get("padding")
        self.by_chunk &= not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", ()))
        super().__init__()
        self.marks = dict(zip(".,", self._library([".", ","]), strict=True))
        self.cuts_marks = not any(re.search("[A-Za-zÀ-ÖØ-öø-ɏ]$|[A-Za-zÀ-ÖØ-öø-ɏ][.,]|^[.,]", t["content"]) for t in spec.get("added_tokens", ()))
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte 0x20
        self.opens[[t["id"] for t in spec.get("added_tokens", ())]] = False

    def _library(self, parts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, of parts that begin with their only space and go on with other than white space."""
        out: list[bytes] = []
        blocks = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for block, e in zip(blocks, self.library.encode_batch_fast(["".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(at) != len(block):
                out += self._library(block)
            else:
                out += [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
        return out

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of each chunk to the table."""
        new = self._recalled(new)
        marked = [(c, m[1], c[-1]) for c in new if c[-1:] in (".", ",") and (m := _MARKED.fullmatch(c))] if self.cuts_marks else []
        alone = [c for c in new if not c or " " in c or c[0].isspace()]
        bare = new.difference(alone, (c for c, _, _ in marked))
        bare.update({w for _, w, _ in marked}.difference(self.chunks))
        joined = list(bare)
        self.chunks.update(zip(joined, self._joined([" " + c for c in joined]), strict=True))
        self.chunks.update([(c, self.chunks[w] + self.marks[mark]) for c, w, mark in marked])
        # A text's first chunk has no space before it.
        parts = [c[len(_FIRST) :] if c.startswith(_FIRST) else " " + c for c in alone]
        self.chunks.update(zip(alone, self._library(parts), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._library(texts)
        self._turn()
        # Chunks are kept without the space before them; a text's first chunk has none, so it is marked.
        found, gaps, new = [], [], set()
        get = self.chunks.get
        for t in texts:
            parts = t.split(" ") if not _RUN.search(t) else _LONE_SPACE.split(t)
            parts[0] = _FIRST + parts[0]
            ids = list(map(get, parts))
            gap = [(i, parts[i]) for i, x in enumerate(ids) if x is None] if None in ids else []
            new.update([c for _, c in gap])
            found.append(ids)
            gaps.append(gap)
        self._learn(new)
        for ids, gap in zip(found, gaps, strict=True):
            for i, c in gap:
                ids[i] = self.chunks[c]
        return [b"".join(ids) for ids in found]


class SentencePieceChunks(_Table):
    """Ids of the sentencepiece library for a .model file, as little-endian 32-bit integers.

    Where the model does not normalise, adds one space before a text, and no piece holds a whitespace
    marker behind another character, pieces cannot cross from a word into the marker after it: each
    distinct marked word is segmented once. Other models, and texts that hold the marker itself, are
    encoded whole."""

    MARK = "▁"

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp = self.library
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        probe = "  é１  é ﬁ\t "
        self.by_chunk = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and sp.decode(sp.encode(probe)) == probe
        self.by_chunk &= sp.encode("a", out_type=str) == [self.MARK + "a"] or sp.encode("a", out_type=str)[0] == self.MARK
        super().__init__()

    def _library(self, parts: list[str]) -> list[bytes]:
        return [_packed(ids) for ids in self.library.encode(parts, num_threads=1)]

    def cut(self, text: str) -> list[str] | None:
        """The chunks of a text, of which the library's ids stand one after the other; None for what is encoded whole. The library puts
        the marker of a chunk before it; an empty chunk is a lone marker at the end of a text (``lone``)."""
        if not self.by_chunk or self.MARK in text or not text:
            return None
        parts = text.split(" ")
        if "" in parts:  # runs of spaces: the markers of a run belong to the word behind it
            joined, run = [], 0
            for p in parts[:-1]:
                if p:
                    joined.append(" " * run + p)
                    run = 0
                else:
                    run += 1
            parts = [*joined, " " * run + parts[-1]]
        return parts

    def lone(self) -> bytes:
        return _packed([self.library.piece_to_id(self.MARK)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._library(texts)
        self._turn()
        cut = [self.cut(t) for t in texts]
        new = self._recalled(set().union(*(c for c in cut if c)).difference(self.chunks))
        alone = [c for c in new if not c]
        self.chunks.update(zip([c for c in new if c], self._library([c for c in new if c]), strict=True))
        for c in alone:
            self.chunks[c] = self.lone()
        get = self.chunks.__getitem__
        whole = iter(self._library([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else b"".join(map(get, c)) for c in cut]


_loaded: dict[str, object] = {}
_KINDS: dict[str, Callable] = {".json": ByteLevelBPE, ".model": SentencePieceChunks}


def load(path: str) -> ByteLevelBPE | SentencePieceChunks:
    """The encoder for a tokenizer file, kept in the worker by path: .json or .model. Tables of other files go."""
    kind = _KINDS.get(os.path.splitext(path)[1])
    if kind is None:
        raise ValueError(f"no encoder for {path}")
    release(path)
    if path not in _loaded:
        _loaded[path] = kind(path)
    return _loaded[path]


def release(but: str | None = None) -> None:
    """Drops the chunk tables that earlier tasks left in a reused worker."""
    for path in [p for p in _loaded if p != but]:
        del _loaded[path]
