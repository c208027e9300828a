"""The queue worked off: rounds of the steps settle, hash, place and verify over the whole catalog, until nothing is ready that moves.

A round takes one step with every file that is ready, from one snapshot, and its result is the next snapshot. So the
number of rounds follows from the steps a file needs, not from the number of files. Rounds read no clock: a file that waits for later than ``now``
waits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sparse_hash_of_bytes
from ..functions.scalars import backoff_ms, div, has_special_mode
from ..schema import DAY, QUEUED
from ..session import stored
from . import verify
from .dedupe import election
from .steps import KEY

MOST_ATTEMPTS = 8
#: Columns of files that the rounds read or set.
FILES = "id domain_id size mtime_ns ctime_ns nlink mode ino first_seen_at state prev_state ready_at attempts skip_reason hash group_id".split()
GROUPS = "group_id domain_id size hash canonical_id".split()


@dataclass(frozen=True)
class Settings:
    now: int
    settle_ms: int = 15 * 60_000
    chunks: int = 16
    length: int = 1 << 20
    align: int = 4096
    block: int = verify.BLOCK


def _cases(rows: DataFrame, cases: list[tuple[Column, dict[str, object]]]) -> DataFrame:
    """rows with the columns of the first case that holds; others stay."""
    names = {c for _, values in cases for c in values}
    which = F.lit(len(cases))
    for k, (cond, _) in reversed(list(enumerate(cases))):
        which = F.when(F.coalesce(cond, F.lit(False)), k).otherwise(which)
    out = rows.withColumn("_case", which)
    values = {}
    for c in names:
        v = F.col(c)
        for k, (_, put) in enumerate(cases):
            if c in put:
                new = put[c] if isinstance(put[c], Column) else F.lit(put[c])
                v = F.when(F.col("_case") == k, new.cast(dict(rows.dtypes)[c])).otherwise(v)
        values[c] = v
    return out.withColumns(values).drop("_case")


def _failed(now: int) -> dict[str, object]:
    """What an error that may pass does to a file."""
    n = F.col("attempts") + 1
    return {"attempts": n, "state": F.when(n >= MOST_ATTEMPTS, "failed").otherwise(F.col("state")), "ready_at": F.when(n < MOST_ATTEMPTS, now + backoff_ms(n))}


def _anew(s: Settings) -> dict[str, object]:
    """A file that has changed settles again, and nothing of its old content counts."""
    return {
        "state": "settling", "prev_state": F.col("state"), "ready_at": s.now + s.settle_ms, "hash": None, "group_id": None,
        "size": F.col("seen.size"), "mtime_ns": F.col("seen.mtime_ns"), "ctime_ns": F.col("seen.ctime_ns"),
    }


def _vanished() -> dict[str, object]:
    return {"prev_state": F.col("state"), "state": "missing", "ready_at": None}


def _skipped(reason: str) -> dict[str, object]:
    return {"state": "skipped", "skip_reason": reason, "ready_at": None}


def _seen(files: DataFrame, observed: DataFrame) -> DataFrame:
    """files with ``seen``: what stands at their place now; a file that was not looked at is as it was."""
    o = observed.select("id", F.struct("gone", "error", "size", "mtime_ns", "ctime_ns", "magic", "hole").alias("o"))
    both = files.join(o, "id", "left")
    put = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(c)).alias(c)
    flag = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(False)).alias(c)
    return both.withColumn("seen", F.struct(flag("gone"), flag("error"), put("size"), put("mtime_ns"), put("ctime_ns"), F.col("o.magic").alias("magic"), flag("hole"))).drop("o")


def _ready(s: Settings) -> Column:
    return F.col("state").isin(*QUEUED) & (F.col("ready_at") <= s.now)


def waiting(files: DataFrame, s: Settings) -> dict[str, int]:
    """How many files are ready for each step."""
    sized, bare = F.col("state") == "sized", F.col("hash").isNull()
    steps = {"settle": F.col("state") == "settling", "hash": sized & bare, "place": sized & ~bare, "verify": F.col("state") == "hashed"}
    return files.where(_ready(s)).agg(*(F.count_if(c).alias(k) for k, c in steps.items())).first().asDict()


@dataclass(frozen=True)
class _Round:
    """One round's snapshot: files with ``seen``, and conditions on them."""

    files: DataFrame
    groups: DataFrame
    content: DataFrame
    s: Settings

    @property
    def gone(self) -> Column:
        return F.col("seen.gone")

    @property
    def changed(self) -> Column:
        return ~(F.col("seen.size").eqNullSafe(F.col("size")) & F.col("seen.mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.col("seen.ctime_ns").eqNullSafe(F.col("ctime_ns")))

    @property
    def first(self) -> list[tuple[Column, dict[str, object]]]:
        """What is looked at before any step."""
        return [(F.col("seen.error"), _failed(self.s.now)), (self.gone, _vanished()), (self.changed, _anew(self.s))]

    @property
    def special(self) -> Column:
        return has_special_mode(F.col("mode").cast("int"))

    @property
    def bad(self) -> Column:
        return F.coalesce(F.col("seen.magic") == "mismatch", F.lit(False))

    @property
    def sized(self) -> Column:
        return _ready(self.s) & (F.col("state") == "sized")

    def bare(self) -> DataFrame:
        """Candidates without a hash, of the sizes that are worked on."""
        sizes = self.files.where(self.sized).select("domain_id", "size").distinct()
        return self.files.where((F.col("state") == "distinct") & F.col("hash").isNull()).join(sizes, ["domain_id", "size"], "left_semi")

    def settle(self) -> DataFrame:
        now, young = self.s.now, div(F.col("mtime_ns"), 1_000_000)
        return _cases(
            self.files.where(_ready(self.s) & (F.col("state") == "settling")),
            [
                *self.first,
                (young > now - self.s.settle_ms, {"ready_at": young + self.s.settle_ms}),
                (F.col("nlink") > 1, _skipped("hardlink")),
                (self.special, _skipped("special_mode")),
                (self.bad, _skipped("bad_magic")),
                (F.col("seen.hole"), {"skip_reason": "suspect_partial", "ready_at": now + DAY}),
                (F.lit(True), {"state": "sized", "skip_reason": None, "ready_at": now}),
            ],
        )

    def hash(self) -> DataFrame:
        """Files that wait for their sparse hash, and candidates of their sizes that have none."""
        s = self.s
        todo = self.files.where(self.sized & F.col("hash").isNull()).unionByName(self.bare())
        new = sparse_hash_of_bytes(F.col("content"), F.octet_length("content").cast("long"), s.chunks, s.length, s.align)
        rows = todo.join(self.content.select("id", new.alias("_new")), "id", "left")
        return _cases(
            rows,
            [
                *self.first,
                ((F.col("state") == "distinct") & (F.col("nlink") > 1), _skipped("hardlink")),
                (self.bad, _skipped("bad_magic")),
                (F.col("_new").isNull(), _failed(s.now)),
                (F.lit(True), {"hash": F.col("_new"), "ready_at": F.when(F.col("state") == "sized", s.now)}),
            ],
        )

    def place(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hashed files go to the first group of their key, else into a new one with the candidates of their key. Returns them, new groups, and
        (group_id, heir) of groups whose canonical file is lost."""
        now, files, groups = self.s.now, self.files, self.groups
        ready = files.where(self.sized & F.col("hash").isNotNull())
        alive = files.where(~F.col("state").isin("missing", "gone")).select(F.col("id").alias("canonical_id"), F.col("group_id").alias("_member"))
        known = groups.groupBy(*KEY).agg(F.min(F.struct("group_id", "canonical_id")).alias("g")).select(*KEY, "g.*")
        known = known.join(alive, "canonical_id", "left").withColumn("_lost", ~F.coalesce(F.col("_member") == F.col("group_id"), F.lit(False)))
        known = known.select(*KEY, F.col("group_id").alias("_group"), F.col("canonical_id").alias("_canonical"), "_lost")
        pending = files.where((F.col("state") == "settling") & (F.col("ready_at") > now)).groupBy("domain_id", "size").agg(F.max("ready_at").alias("_until"))
        unhashed = self.bare().select("domain_id", "size").distinct().withColumn("_bare", F.lit(True))
        sound = ~self.gone & ~self.changed & (F.col("nlink") == 1)
        candidates = files.where(((F.col("state") == "distinct") | self.sized) & F.col("hash").isNotNull() & sound)
        elected = candidates.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min(election()).alias("_best")).select(*KEY, "_n", F.col("_best.id").alias("_first"))
        heirs = ready.where(~self.gone & ~self.changed & ~F.col("seen.error")).groupBy(*KEY).agg(F.min(election()).alias("_h")).select(*KEY, F.col("_h.id").alias("_heir"))
        free = ready.unionByName(files.where((F.col("state") == "distinct") & F.col("hash").isNotNull()))
        both = free.join(known, list(KEY), "left").join(pending, ["domain_id", "size"], "left").join(unhashed, ["domain_id", "size"], "left").join(elected, list(KEY), "left").join(heirs, list(KEY), "left")
        base = (groups.agg(F.max("group_id")).first()[0] or 0) + 1
        mine, in_group = F.col("state") == "sized", F.col("_group").isNotNull()
        open_ = F.col("_heir").isNotNull() & ~in_group & F.col("_until").isNull() & F.col("_bare").isNull() & (F.col("_n") > 1)
        joins = open_ & sound
        placed = _cases(
            both,
            [
                *((mine & c, v) for c, v in self.first),
                (mine & in_group & (F.col("_canonical") == F.col("id")) & ~F.col("_lost"), {"state": "canonical", "group_id": F.col("_group"), "ready_at": None}),
                (mine & in_group & F.col("_lost") & (F.col("_heir") == F.col("id")), {"state": "canonical", "group_id": F.col("_group"), "ready_at": None}),
                (mine & in_group, {"state": "hashed", "group_id": F.col("_group"), "ready_at": now}),
                (mine & F.col("_until").isNotNull(), {"ready_at": F.col("_until")}),
                (joins & (F.col("_first") == F.col("id")), {"state": "canonical", "group_id": base + F.col("_first"), "ready_at": None}),
                (joins, {"state": "hashed", "group_id": base + F.col("_first"), "ready_at": now}),
                (mine & F.col("_bare").isNull(), {"state": "distinct", "ready_at": None}),
            ],
        )
        placed = stored(placed.select(*FILES, "seen", "_lost", "_first"), "placed")
        canonical = placed.where(F.col("state") == "canonical")
        made = canonical.where((F.col("group_id") == base + F.col("_first")) & (F.col("id") == F.col("_first")) & F.col("_lost").isNull())
        made = made.select("group_id", *KEY, F.col("id").alias("canonical_id"))
        return placed.select(FILES), made, canonical.where("_lost").select("group_id", F.col("id").alias("_heir"))

    def verify(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members of groups that are to be compared with their canonical file: those whose turn it is not (with what becomes of them), those to be compared, and
        (group_id, heir) of groups whose canonical file is lost, seen to be gone or changed."""
        now, files, groups = self.s.now, self.files, self.groups
        check = files.where(_ready(self.s) & (F.col("state") == "hashed"))
        canon = groups.select("group_id", F.col("canonical_id").alias("_canonical"), F.lit(True).alias("_there"))
        stand = files.select(F.col("id").alias("_canonical"), F.col("group_id").alias("_member"), (self.gone | self.changed).alias("_off"), F.col("state").isin("missing", "gone").alias("_dead"))
        both = check.join(canon, "group_id", "left").join(stand, "_canonical", "left")
        lost = F.col("_member").isNull() | (F.col("_member") != F.col("group_id")) | F.col("_dead") | F.col("_off")
        both = both.withColumn("_lost", F.coalesce(lost, F.lit(True)) & F.col("_there").isNotNull())
        usable = ~self.gone & ~self.changed & ~F.col("seen.error") & (F.col("nlink") == 1) & ~self.special
        heirs = both.where(F.col("_lost") & usable).groupBy("group_id").agg(F.min(election()).alias("_h")).select("group_id", F.col("_h.id").alias("_heir"))
        steps = _cases(
            both.join(heirs, "group_id", "left"),
            [
                (F.col("group_id").isNull() | F.col("_there").isNull(), {"state": "sized", "group_id": None, "ready_at": now}),
                *self.first,
                (F.col("nlink") > 1, _skipped("hardlink")),
                (self.special, _skipped("special_mode")),
                (F.col("_lost") & (F.col("_heir") == F.col("id")), {"state": "canonical", "ready_at": None}),
                (~F.col("_lost") & (F.col("_canonical") == F.col("id")), {"state": "canonical", "ready_at": None}),
            ],
        )
        steps = stored(steps.select(*FILES, "seen", "_lost", "_heir"), "to-verify")
        compared = (F.col("state") == "hashed") & (F.col("ready_at") <= now) & ~F.col("_lost")
        heirs = steps.where(F.col("_lost") & (F.col("_heir") == F.col("id"))).select("group_id", "_heir")
        return steps.where(~compared).select(FILES), steps.where(compared).select(FILES), heirs


def one_round(files: DataFrame, groups: DataFrame, content: DataFrame, observed: DataFrame, s: Settings, due: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The next files and groups, and the comparisons (group_id, src, dst, same, at) if there were any. due: see ``waiting``.

    files: FILES. groups: GROUPS. content: id and content (binary). observed: id, gone, error (one that may pass), size, mtime_ns, ctime_ns,
    magic, hole, at most one row for a file."""
    due = due or waiting(files, s)
    r = _Round(stored(_seen(files.select(FILES), observed), "files"), groups, content, s)
    parts, made, heirs, events = [], [], [], None
    if due["settle"]:
        parts.append(r.settle())
    if due["hash"] or due["place"]:
        parts.append(r.hash())
    if due["place"]:
        placed, new, lost = r.place()
        parts.append(placed)
        made.append(new)
        heirs.append(lost)
    if due["verify"]:
        steady, rest, lost = r.verify()
        parts.append(steady)
        heirs.append(lost)
        members = rest.select("id", "group_id", *KEY)
        bytes_ = verify.blocks(content.join(members.select("id").union(groups.select("canonical_id")).distinct(), "id", "left_semi"), s.block)
        verdict, new, events = verify.settle_members(members, groups, bytes_, s.block)
        made.append(new.select(GROUPS))
        ended = rest.join(verdict.select("id", F.col("group_id").alias("_to"), F.col("state").alias("_state")), "id", "left")
        parts.append(_cases(ended, [(F.col("_state").isNotNull(), {"state": F.col("_state"), "group_id": F.col("_to"), "ready_at": None}), (F.lit(True), _failed(s.now))]))
    touched = parts[0].select(FILES)
    for x in parts[1:]:
        touched = touched.unionByName(x.select(FILES))
    if heirs:
        heir = heirs[0] if len(heirs) == 1 else heirs[0].union(heirs[1])
        heir = stored(heir.groupBy("group_id").agg(F.min("_heir").alias("_heir")), "heirs")
        groups = groups.join(heir, "group_id", "left").select("group_id", *KEY, F.coalesce("_heir", "canonical_id").alias("canonical_id"))
        # A canonical file that was seen to be gone or changed while others waited for it.
        off = r.files.where((F.col("state") == "canonical") & (r.gone | r.changed)).join(heir.select("group_id"), "group_id", "left_semi")
        touched = touched.unionByName(_cases(off, [(r.gone, _vanished()), (F.lit(True), _anew(s))]).select(FILES))
    touched = stored(touched, "touched")
    for new in made:
        groups = groups.unionByName(new)
    return r.files.select(FILES).join(touched.select("id"), "id", "left_anti").unionByName(touched), groups, events


def drain(files: DataFrame, groups: DataFrame, content: DataFrame, observed: DataFrame, s: Settings, most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Files and groups when no file is ready any more, all comparisons with their round, and the rounds it took. A queue that has
    not come to rest after ``most`` rounds is an error."""
    files, groups = stored(files.select(FILES), "files"), stored(groups.select(GROUPS), "groups")
    told = groups.select("group_id", F.col("group_id").alias("src"), F.col("group_id").alias("dst"), F.lit(True).alias("same"), F.col("group_id").alias("at"), F.lit(0).alias("round")).where("false")
    for n in range(most + 1):
        due = waiting(files, s)
        if not any(due.values()):
            return files, groups, told, n
        after, groups, events = one_round(files, groups, content, observed, s, due)
        files, groups = stored(after, "files"), stored(groups, "groups")
        if events is not None:
            told = told.unionByName(stored(events.withColumn("round", F.lit(n + 1)), "comparisons"))
    raise RuntimeError(f"the queue has not come to rest after {most} rounds")
