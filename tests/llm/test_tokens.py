import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from siftline.llm import token_store as S
from siftline.llm.queries import op2_token_store, op5_token_counts, op8_sentencepiece
from siftline.llm.sentencepiece_codec import encode_decode
from siftline.llm.token_counts import count_tokens
from siftline.llm.tokenization import load
from tokenizers import Tokenizer

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a ", " a", "  a  b   c ", "foo\n bar", "x\n \ny", "a<|endoftext|> b", "it's  don't", " \n", "a▁b ▁", "日本 語", "é１ ﬁ\t", "l'été, ça.\nOui..\n\nNon", "w" * 5000, "the cat " * 4000]


def fuzz(n):
    rnd = random.Random(5)
    parts = ["a", "É", " ", " ", "\n", "\t", ".", ",", "1", "'s", "<|endoftext|>", "▁", "\x0b", "\x1d", "ß", "\xa0"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD + fuzz(300))] + [(None, "no id"), (3, "  "), (7, "other text of the same id")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3), rows


LIBRARY = Tokenizer.from_file(BPE)


def bpe(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_chunk_tables_give_the_libraries_ids():
    texts = [t or "" for t in ODD] + fuzz(3000)
    for path in (BPE, PIECE):
        e = load(path)
        assert e.by_chunk
        assert e.encode(texts) == e._library(texts)


def test_counts(spark, docs, tmp_path):
    df, rows = docs
    key = lambda r: (r[0] is None, r)
    want = sorted(((i, len((t or "").encode()), n, n > 512) for i, t in rows for n in [len(bpe(t))]), key=key)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds all in the cache
        assert sorted((tuple(r) for r in count_tokens(df, BPE, cache).collect()), key=key) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in rows})
    assert count_tokens(df.limit(0), BPE).collect() == []


def test_cache_is_trusted_and_versioned(spark, tmp_path):
    """Counts come from the cache where it has them, and only for the same tokenizer."""
    cache, text = f"file://{tmp_path}/cache", "some text"
    row = (hashlib.sha256(open(BPE, "rb").read()).hexdigest(), bytearray(hashlib.sha256(text.encode()).digest()), 77)
    other = ("another version", row[1], 99)
    spark.createDataFrame([row, other], "tokenizer string, content binary, n_tokens long").write.parquet(cache)
    assert count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), BPE, cache).first().n_tokens == 77


def test_sentencepiece(spark, docs):
    df, rows = docs
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    key = lambda r: (r[0] is None, str(r))
    want = sorted(((i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in encode_decode(df, PIECE).collect()), key=key) == want
    assert encode_decode(df.limit(0), PIECE).collect() == []


def test_store_round_trip(spark, docs, tmp_path):
    df, rows = docs
    path = f"file://{tmp_path}/store"
    S.write_store(df, path, BPE, 2)
    got = sorted(((r.start, r.doc_id, r.ids) for r in S.read_ids(spark, path).collect()), key=lambda r: r[0])
    assert sorted((str(i), x) for _, i, x in got) == sorted((str(i), [*bpe(t), 2]) for i, t in rows)
    assert [i for _, i, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [s for s, _, _ in got] == list(np.cumsum([0] + [len(x) for _, _, x in got[:-1]]))
    digests = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in S.read_digests(spark, path).collect())
    assert digests == [(s, i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for s, i, x in got]
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").selectExpr("sum(n_docs)", "sum(n_tokens)").first()[:] == (len(rows), sum(len(x) for _, _, x in got))
    S.write_store(df.limit(0), f"file://{tmp_path}/none", BPE, 2)
    assert S.read_digests(spark, f"file://{tmp_path}/none").collect() == []


def test_copies_share_chunks_and_damage_is_found(spark, tmp_path):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(9000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "some words first " + long)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    S.write_store(df, path, BPE, 2)
    objects = spark.read.parquet(f"{path}/objects")
    stored = sum(len(r.payload) // 2 for r in objects.where("kind = 'chunk'").collect())
    assert stored < 1.4 * (len(bpe(long)) + 1)
    bad = objects.where("kind = 'chunk'").selectExpr("key", "concat(payload, X'0100') payload")
    with pytest.raises(ValueError, match="does not hold"):
        list(S._read_chunks(iter(bad.toArrow().to_batches()), 2))


def test_crc_of_parts():
    rnd = random.Random(2)
    for _ in range(50):
        parts = [rnd.randbytes(rnd.randrange(0, 3000)) for _ in range(rnd.randrange(0, 5))]
        assert S.crc32_of_parts([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_queries_against_the_libraries(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids = {i: bpe(t) for i, t in rows}
    assert sorted(tuple(r)[:4] for r in op5_token_counts(spark, SF).collect()) == [(i, len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in rows]
    start, want = 0, []
    for i, _ in rows:
        want.append((i, start, len(ids[i]) + 1, zlib.crc32(np.asarray([*ids[i], 2], "<u4").tobytes())))
        start += len(ids[i]) + 1
    assert sorted(tuple(r)[:4] for r in op2_token_store(spark, SF).collect()) == want
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(e), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in rows for e in [sp.encode(t)]]
    assert sorted(tuple(r)[:4] for r in op8_sentencepiece(spark, SF).collect()) == want
