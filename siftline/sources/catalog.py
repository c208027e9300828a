"""A file catalog read from the documents table, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of all queries: no operator reads one.
NOW = 1_704_067_200_000 + 90 * 86_400_000


def _case(key: str, values: tuple, otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


_DOC = "CAST(doc_id AS STRING)"
_EXT = _case("doc_id % 17", ("'.txt'", "'.MKV'", "''", "'.mov'"), "'.mp4'")
_NAME = _case(
    "doc_id % 23",
    (f"'.v' || {_DOC} || '.mp4.aBc123'", f"'._v' || {_DOC} || '.mp4'", f"'~$v' || {_DOC} || '.mp4'", f"'v' || {_DOC} || '.mp4.PART'", f"'.syncthing.v' || {_DOC} || '.tmp'", f"'v' || {_DOC} || '.ocTransferId77.part'"),
    f"'v' || {_DOC} || {_EXT}",
)
_DIR = _case("doc_id % 19", ("'@eaDir/'", "'.Trash-1000/'", "'a/#recycle/'", "'a-b/'", "'a/'"), "''")
_STATE = _case("doc_id % 11", ("'settling'", "'sized'", "'hashed'", "'verified'", "'deduped'", "'distinct'", "'canonical'", "'skipped'", "'failed'", "'missing'", "'gone'"))

COLUMNS: dict[str, str] = {
    "id": "doc_id",
    "sub_id": "'01'",
    "ino": "doc_id",
    "domain_id": "'01'",
    "root_id": "1 + doc_id % 3",
    "rel_path": f"{_DIR} || lang || '/' || source || '/' || {_NAME}",
    "owner_uid": "1000 + CAST(substring(source, 4) AS INT)",
    "mode": "CASE WHEN doc_id % 101 = 0 THEN 35309 ELSE 33188 END",
    "size": "{size}",
    "mtime_ns": "(1704067200000 + doc_id * 60000) * 1000000 + doc_id % 7",
    "ctime_ns": "(1704067200000 + doc_id * 60000 + doc_id % 5 * 1000) * 1000000",
    "nlink": "CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END",
    "state": _STATE,
    "prev_state": "CASE WHEN doc_id % 11 = 9 THEN " + _case("doc_id % 5", ("'hashed'", "'deduped'", "'missing'", "'sized'")) + " END",
    "ready_at": f"CASE WHEN doc_id % 11 IN (0, 1, 2) AND doc_id % 4 <> 0 THEN {NOW} - 3600000 + doc_id % 90 * 60000 END",
    "priority": "CAST(doc_id % 3 AS INT)",
    "heavy_wait_since": f"CASE WHEN doc_id % 6 = 0 THEN {NOW} - doc_id % 100 * 3600000 END",
    "attempts": "CAST(doc_id % 9 AS INT)",
    "last_error": "CASE WHEN doc_id % 13 = 0 THEN 'io' END",
    "skip_reason": "CASE WHEN doc_id % 11 = 7 THEN CASE WHEN doc_id % 2 = 0 THEN 'user_undo' ELSE 'hardlink' END END",
    "group_id": "CASE WHEN doc_id % 11 IN (2, 3, 4, 6) THEN 1 + doc_id % 40 END",
    "first_seen_at": "1704067200000 + doc_id % 50 * 60000",
    "last_seen_at": "1704067200000 + doc_id * 60000",
    "updated_at": f"{NOW} - doc_id % 500 * 86400000",
    "content": "text",
}
ROOTS = "(VALUES (1, '/volume1/video', 'local', CAST(NULL AS STRING)), (2, '/volume1/video/b', 'local', NULL), (3, '/mnt/far', 'remote', 'far'))"


def sql(size: str) -> str:
    """The catalog's SELECT; size is the engine's expression for the bytes of text."""
    return "SELECT " + ", ".join(f"{e.replace('{size}', size)} AS {n}" for n, e in COLUMNS.items()) + " FROM documents"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*(f"{e.replace('{size}', 'CAST(octet_length(text) AS BIGINT)')} AS {n}" for n, e in COLUMNS.items()))


def roots(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {ROOTS} AS r(root_id, path, kind, label)")
