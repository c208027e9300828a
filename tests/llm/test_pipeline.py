import hashlib

import corpus_pipeline as P
import public_tokenizers
import sentencepiece

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept: its columns, its rows, and that its decisions take effect."""
    from siftline.llm.decontaminate import leaks
    from siftline.llm.line_dedup import dedup_lines
    from siftline.llm.near_dedup import near_duplicates
    from siftline.llm.quality import score

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == P.COLUMNS
        out.write.parquet(f"file://{tmp_path}/{k}")
        kept.append(docs)
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
    kept.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] > ids[1] and ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5] and len(ids[5]) > 50
    assert ids[1] == {r.doc_id for r in score(kept[0]).where("kept").collect()}
    # A document goes with its last word, not with the last of the lines that took part.
    assert ids[2] == {r.doc_id for r in dedup_lines(kept[1]).collect() if not r.n_removed or r.text.split()}
    assert ids[3] == {r.doc_id for r in near_duplicates(kept[2]).where("kept").collect()}
    assert ids[4] == ids[3] - {r.doc_id for r in leaks(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept[2].where("n_chars <> length(text)").count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    for r in kept[5].collect():
        e = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
