"""The corpus-wide chunk table against the library, text by text."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from siftline.llm.chunk_table import chunk_table, encode_by_table
from siftline.llm.sentencepiece_codec import DIGESTS, digests

PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("sent", [0, 1 << 40])
def test_against_the_library(spark, sent):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, " "), (-4, "   a  b "), (-5, "x▁y z"), (-6, "\n\ta b\n"), (-7, "a " * 50_000), (-8, "\U0001f600\x00 é"), (-9, "a" * 3000), (None, "a b"), (None, "a b"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS chunk", "1 AS size", "2 AS t1").repartition(3)

    def want(i, t):
        ids = sp.encode(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    got = sorted((tuple(r) for r in encode_by_table(docs, PIECE, digests, DIGESTS, sent).collect()), key=str)
    assert got == sorted((want(i, t) for i, t in rows), key=str)


def test_no_rows_and_each_chunk_once(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_by_table(none, PIECE, digests, DIGESTS).collect() == []
    docs = spark.createDataFrame([(i, f"the same words and {i % 7}") for i in range(300)], "doc_id long, text string").repartition(4)
    assert sorted(r.chunk for r in chunk_table(docs, PIECE).collect()) == sorted(["the", "same", "words", "and", *map(str, range(7))])
