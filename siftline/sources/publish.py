"""Snapshots that readers see whole or not at all, and reports as text, CSV or JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], path: str) -> int:
    """Writes a new version of all tables, then creates its marker, which is what makes it current; returns its number. Two
    writers of one number cannot both create it: the second fails, and its tables are never read."""
    spark = next(iter(tables.values())).sparkSession
    at, fs = _path(spark, f"{path}/published")
    number = 1 + max([int(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else [0], default=0)
    version = f"{number}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    out = fs.create(_path(spark, f"{path}/published/{number}")[0], False)
    out.writeBytes(version)
    out.close()
    return number


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version published last."""
    at, fs = _path(spark, f"{path}/published")
    number = max(int(f.getPath().getName()) for f in fs.listStatus(at))
    version = spark.read.text(f"{path}/published/{number}").first()[0]
    return spark.read.parquet(f"{path}/{version}/{name}")


def write_report(groups: DataFrame, path: str, kind: str) -> None:
    """The report as CSV (with a header) or JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError(f"no output as {kind}")
    groups.write.mode("errorifexists").option("header", True).format(kind).save(path)


def _size(n: int) -> str:
    units, value = ["B", "KiB", "MiB", "GiB", "TiB"], float(n)
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{n} B" if units[0] == "B" else f"{value:.1f} {units[0]}"


def report_text(totals: DataFrame, groups: DataFrame, members: DataFrame, limit: int = 50) -> str:
    """The totals of all groups, then the first ``limit`` with their members: a report for people, so of bounded length."""
    t = totals.first()
    out = [f"{t.groups} groups; shared {_size(t.shared)}, verified {_size(t.verified)}, suspected {_size(t.suspected)}; {t.cross_groups} across machines"]
    first = groups.orderBy(groups.reclaimable.desc(), groups.group_id).limit(limit)
    paths: dict[int, list] = {}
    for r in members.join(first.select("group_id"), "group_id").orderBy("id").collect():
        paths.setdefault(r.group_id, []).append(r.rel_path)
    for g in first.collect():
        out.append(f"#{g.group_id}: {g.members} x {_size(g.size)}, {_size(g.reclaimable)} reclaimable")
        out += [f"  {p}" for p in paths.get(g.group_id, ())]
    return "\n".join(out)


def status_text(lines: DataFrame) -> str:
    """Sections of a status (section, name, value), in order."""
    out, last = [], None
    for r in lines.orderBy("section", "name").collect():
        out += [] if r.section == last else [f"{r.section}:"]
        out.append(f"  {r.name}: {r.value}")
        last = r.section
    return "\n".join(out)
