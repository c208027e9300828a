"""A content-addressed store of token ids.

Texts are encoded with an end id, a rolling hash over the ids cuts each stream into chunks, and each
distinct chunk is stored once under its digest. A store is a folder of Parquet tables:

- objects/kind=chunk: key (BLAKE2b-128 of the payload), payload (little-endian ids of ``width`` bytes);
- recipes: in ascending doc_id order, the chunk keys of each document, its token count, the position of
  its first id in the whole stream and the Merkle root of its keys;
- manifest: for each range of recipes, documents, tokens and the Merkle root of the documents' roots."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare, stored
from .tokenization import load

#: Chunk lengths in ids: least, mean of the cuts beyond it (a power of two), most.
LEAST, MEAN_BITS, MOST = 256, 10, 4096
KEY = 16
#: Chunk keys that a task remembers, so as to send a payload that it meets again only once.
REMEMBERED = 200_000

_RECIPE = "part int, row long, doc_id long, start long, n_tokens long, root binary, keys binary"
_OBJECT = "kind string, key binary, payload binary, doc_id long, n_tokens long, root binary"


def chunk_key(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=KEY).digest()


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is; no keys have the digest of nothing."""
    level = [chunk_key(b"\x00" + k) for k in keys] or [chunk_key(b"")]
    while len(level) > 1:
        up = [chunk_key(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) & ~1 :]
    return level[0]


@lru_cache(2)
def _id_values(size: int) -> np.ndarray:
    return K.mix(np.arange(1, size + 1, dtype=K.U64))


def _cuts(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 ids asks for a cut.

    Texts follow each other without a gap: the first LEAST ids of a text, which are all that see ids of the
    text before, are never cut."""
    h = _id_values(1 << int(ids.max(initial=0)).bit_length())[ids]
    step = 1
    while step < 32:
        h[step:] += h[:-step] << K.U64(step)
        step *= 2
    return np.flatnonzero(h >> K.U64(64 - MEAN_BITS) == 0) + 1


def _chunks(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids: cuts closer than LEAST are passed over, MOST is the longest."""
    ends, at = [], 0
    for c in [*cuts, n]:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST or c == n > at:
            at = c
            ends.append(at)
    return ends


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    encoder, known = load(tokenizer), set()
    tail = np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        text = batch.column(1)
        doc_ids = batch.column(0).to_pylist()
        for a, b, _, _ in K.texts(text):
            encoded = [x + tail for x in encoder.encode(text.slice(a, b - a).to_pylist())]
            ids = np.frombuffer(b"".join(encoded), "<u4")
            off = np.concatenate(([0], np.cumsum([len(x) // 4 for x in encoded])))
            cuts = _cuts(ids)
            raw, bound = ids.astype(f"<u{width}").tobytes(), np.searchsorted(cuts, off, "right")
            rows: list[tuple] = []
            for i in range(b - a):
                start, n = int(off[i]), int(off[i + 1] - off[i])
                keys, at = [], 0
                for end in _chunks(n, (cuts[bound[i] : bound[i + 1]] - start).tolist()):
                    payload = raw[(start + at) * width : (start + end) * width]
                    at = end
                    keys.append(chunk_key(payload))
                    if keys[-1] not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add(keys[-1])
                        rows.append(("chunk", keys[-1], payload, None, None, None))
                root = merkle(keys)
                rows.append(("recipe", root, b"".join(keys), doc_ids[a + i], n, root))
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "key", "payload", "doc_id", "n_tokens", "root"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a chunk that follows one of the same key in a sorted partition."""
    last = None
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for i, (kind, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            keep[i] = kind != "chunk" or key != last
            last = key if kind == "chunk" else last
        yield batch.filter(pa.array(keep))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the row in it and the ids before the row in it."""
    part, row, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(np.arange(row, row + len(n)), pa.int64()), pa.array(ends - n, pa.int64())], [*batch.schema.names, "part", "row", "before"])
        row, before = row + len(n), int(ends[-1]) if len(n) else before


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text) and writes a store at ``path``, which must not exist.

    Null counts as the empty text: its stream is the end id alone. doc_id may be null (such rows come
    first) and may repeat (rows of one id are ordered by their roots). width: bytes of an id; ids that do
    not fit raise an error. Other columns are ignored; an empty table gives an empty store.
    Only chunks and keys are shuffled, each chunk at most once from a task; a chunk that very many documents
    hold so meets one row from each task."""
    spark = docs.sparkSession
    prepare(spark)
    if end_id >= 1 << 8 * width or load(tokenizer).library.get_vocab_size() > 1 << 8 * width:
        raise ValueError(f"ids need more than {width} bytes")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    objects = docs.mapInArrow(partial(_encode, tokenizer=tokenizer, end_id=end_id, width=width), _OBJECT)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    objects = objects.repartition(n, "key", "doc_id").sortWithinPartitions("kind", "key").mapInArrow(_once, _OBJECT)
    objects.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema(_OBJECT).parquet(f"{path}/objects").where("kind = 'recipe'").select("doc_id", "n_tokens", "root", F.col("payload").alias("keys"))
    recipes = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    schema = "doc_id long, n_tokens long, root binary, keys binary, part int, row long, before long"
    recipes = stored(recipes.mapInArrow(_number, schema), "recipes")
    # One row for each range: as many as shuffle partitions, however many documents there are.
    sizes = sorted(tuple(r) for r in recipes.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for part, tokens in sizes:
        starts.append((part, total))
        total += tokens
    starts = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    recipes = recipes.join(starts, "part").select("part", "row", "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "root", "keys")
    recipes = recipes.repartitionByRange(F.col("part"), F.col("row")).sortWithinPartitions("part", "row")
    recipes.write.parquet(f"{path}/recipes")
    parts = spark.read.parquet(f"{path}/recipes").select("part", "n_tokens", "root", "row")
    parts.groupBy("part").applyInArrow(_part_manifest, "part int, n_docs long, n_tokens long, root binary").withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")


def _part_manifest(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("row")
    root = merkle(rows.column("root").to_pylist())
    return pa.table([pa.array([rows.column("part")[0].as_py()], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([sum(rows.column("n_tokens").to_pylist())], pa.int64()), pa.array([root], pa.binary())], ["part", "n_docs", "n_tokens", "root"])


@lru_cache(1)
def _zero_operators() -> list[list[list[int]]]:
    """For each power of two, four byte tables of the CRC-32 operator that appends so many zero bytes."""
    def times(matrix: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= matrix[i]
            v >>= 1
            i += 1
        return out

    one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        one = [times(one, x) for x in one]
    found = []
    for _ in range(40):
        found.append([[times(one, byte << 8 * k) for byte in range(256)] for k in range(4)])
        one = [times(one, x) for x in one]
    return found


def crc32_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes joined from parts, given each part's (length in bytes, CRC-32)."""
    crc, operators = 0, _zero_operators()
    for size, own in parts:
        bit = 0
        while size:
            if size & 1:
                t = operators[bit]
                crc = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]
            size >>= 1
            bit += 1
        crc ^= own
    return crc


def _read_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, n, crc = batch.column(0).to_pylist(), [], []
        for key, payload in zip(keys, batch.column(1).to_pylist(), strict=True):
            if chunk_key(payload) != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its key says")
            ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for doc_id, n_tokens, root, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "chunks")), strict=True):
            chunks = sorted(chunks, key=lambda c: c["pos"])
            if merkle([c["key"] for c in chunks]) != root or sum(c["n"] for c in chunks) != n_tokens or [c["pos"] for c in chunks] != list(range(len(chunks))):
                raise ValueError(f"document {doc_id} does not match its recipe")
            crc.append(crc32_of_parts([(4 * c["n"], c["crc"]) for c in chunks]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes")


def _refs(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe: pos, key."""
    count = (F.octet_length("keys") / KEY).cast("int")
    return recipes.withColumn("pos", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("key", F.expr(f"substring(keys, pos * {KEY} + 1, {KEY})")).drop("keys")


def _check_counts(spark: SparkSession, path: str) -> None:
    """Raises an error unless each range has the documents and tokens that its manifest row says."""
    recipes = _recipes(spark, path).groupBy("part").agg(F.count("*").alias("d"), F.sum("n_tokens").alias("t"))
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "n_docs", F.col("n_tokens").alias("tokens"))
    wrong = manifest.join(recipes, "part", "full_outer").where(~(F.col("n_docs").eqNullSafe(F.col("d")) & F.col("tokens").eqNullSafe(F.col("t"))))
    if bad := [r.part for r in wrong.select("part").orderBy("part").limit(10).collect()]:
        raise ValueError(f"recipes do not match the manifest in ranges {bad}")


def verify_manifest(spark: SparkSession, path: str) -> str:
    """The Merkle root over all ranges, in hex, after each range's documents, tokens and root were taken from the
    recipes anew and compared with its manifest row; an error where they differ. A range's roots are one task's, as when it
    was written."""
    _check_counts(spark, path)
    own = _recipes(spark, path).select("part", "n_tokens", "root", "row").groupBy("part").applyInArrow(_part_manifest, "part int, n_docs long, n_tokens long, root binary")
    said = spark.read.parquet(f"{path}/manifest").select("part", F.col("root").alias("said"))
    rows = said.join(own.select("part", "root"), "part", "full_outer").orderBy("part").collect()  # one for each range
    if bad := [r.part for r in rows if r.root != r.said]:
        raise ValueError(f"recipes do not match the manifest in ranges {bad[:10]}")
    return merkle([bytes(r.root) for r in rows]).hex()


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each document, all
    read from the store's files and verified: every range's counts against the manifest (its root by ``verify_manifest``),
    every chunk against its key, every document against its Merkle root and count. A chunk is read once; documents get their checksum from those of their chunks."""
    _check_counts(spark, path)
    chunks = spark.read.schema(_OBJECT).parquet(f"{path}/objects").where("kind = 'chunk'").select("key", "payload")
    chunks = chunks.mapInArrow(partial(_read_chunks, width=width), "key binary, n long, crc long")
    refs = _refs(_recipes(spark, path)).join(stored(chunks, "chunks"), "key", "left")
    docs = refs.groupBy("part", "row", "doc_id", "start", "n_tokens", "root").agg(F.collect_list(F.struct("pos", "key", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))).alias("chunks"))
    return docs.mapInArrow(_verify, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _join(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b"".join(c["payload"] for c in sorted(row, key=lambda c: c["pos"])), f"<u{width}").astype(np.int32) for row in batch.column(2).to_pylist()]
        off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start and ids (array<int>, with the end id) of each document, put together from its chunks."""
    chunks = spark.read.schema(_OBJECT).parquet(f"{path}/objects").where("kind = 'chunk'").select("key", "payload")
    refs = _refs(_recipes(spark, path)).join(chunks, "key")
    docs = refs.groupBy("part", "row", "doc_id", "start").agg(F.collect_list(F.struct("pos", "payload")).alias("chunks"))
    return docs.select("doc_id", "start", "chunks").mapInArrow(partial(_join, width=width), "doc_id long, start long, ids array<int>")
