"""Fixed values of the catalog's data model: enumerations, the transition table, error policies."""

from __future__ import annotations

# Fixed values.
STATES = ("settling", "sized", "hashed", "verified", "deduped", "distinct", "canonical", "skipped", "failed", "missing", "gone")
QUEUED = ("settling", "sized", "hashed")
TERMINAL = ("verified", "deduped", "distinct", "canonical", "skipped", "failed", "missing", "gone")
CANDIDATE = ("sized", "distinct")
IN_GROUP = ("hashed", "verified", "deduped", "canonical")
RESTORABLE = ("settling", "sized", "hashed", "verified", "deduped", "distinct", "canonical", "skipped", "failed")

# Legal transitions and their reasons.
RULES = (
    ("settling", "sized", "settled"),
    ("settling", "skipped", "rejected"),
    ("sized", "skipped", "rejected"),
    ("sized", "distinct", "no_match"),
    ("sized", "hashed", "matched"),
    ("sized", "canonical", "became_canonical"),
    ("hashed", "deduped", "shared"),
    ("hashed", "verified", "dry_run_same"),
    ("hashed", "hashed", "next_group"),
    ("hashed", "canonical", "became_canonical"),
    ("hashed", "skipped", "rejected"),
    ("hashed", "failed", "failed"),
    ("verified", "hashed", "requeued"),
    ("distinct", "canonical", "became_canonical"),
    ("deduped", "canonical", "promoted"),
    ("deduped", "skipped", "user_undo"),
    ("canonical", "skipped", "user_undo"),
    *((s, "settling", "changed") for s in ("sized", "hashed", "verified", "deduped", "distinct", "canonical", "skipped", "failed", "missing")),
    *((s, "missing", "vanished") for s in STATES[:9]),
    *(("missing", s, "restored") for s in STATES[1:9]),
    ("missing", "gone", "expired"),
)

# What to do after an error number.
ERRNO_POLICY = (
    (4, "retry_now"),
    (95, "park_domain"),
    (25, "park_domain"),
    (18, "pair_impossible"),
    (22, "pair_impossible"),
    (30, "pair_impossible"),
    (26, "pair_impossible"),
    (1, "backoff_alert"),
    (13, "backoff_alert"),
    (28, "backoff"),
    (11, "backoff"),
    (16, "backoff"),
    (12, "backoff"),
    (5, "backoff"),
    (2, "pair_impossible"),
    (116, "pair_impossible"),
    (9, "fail"),
    (21, "fail"),
)

# File name extensions, system directories, temporary suffixes.
EXTENSIONS = "mp4 mov m4v mkv webm avi ts mts m2ts mxf wmv mpg mpeg vob 3gp r3d braw insv".split()
EXCLUDED = [".snapshots", ".zfs", ".Trash-*", ".siftline", ".recycle", "@eaDir", ".@__thumb", "#recycle", "@Recycle", "#snapshot", "@Recently-Snapshot", "@tmp"]
FLAVORS = {
    "synology": ["@eaDir", "#recycle", "#snapshot", "@tmp", "@sharebin"],
    "qnap": ["@Recycle", ".@__thumb", "@Recently-Snapshot", ".@upload_cache"],
    "truenas": [".recycle", ".windows", ".zfs"],
    "unraid": [".Recycle.Bin", "appdata"],
    "omv": ["aquota.user", "aquota.group"],
    "generic": [],
}
TEMP_SUFFIXES = [".part", ".crdownload", ".filepart", ".partial", ".download", ".tmp"]

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
