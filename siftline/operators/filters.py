"""The cheap filters, in order: the first that rejects a path gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXTENSIONS, TEMP_SUFFIXES


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; null where a name has none or only a leading dot."""
    ext = F.regexp_extract(file_name(path), r"^.+\.([^.]+)\z", 1)
    return F.when(ext != "", F.lower(ext))


def in_excluded_dir(path: Column, excluded: list[str]) -> Column:
    """A component, the file name included, is an excluded name or starts with one that ends in '*'."""
    names = [x for x in excluded if not x.endswith("*")]
    prefixes = [x[:-1] for x in excluded if x.endswith("*")]

    def bad(c: Column) -> Column:
        out = c.isin(*names)
        for p in prefixes:
            out |= c.startswith(p)
        return out

    return F.exists(F.split(path, "/"), bad)


def is_temp_name(name: Column) -> Column:
    suffix = "|".join(s.replace(".", r"\.") for s in TEMP_SUFFIXES)
    return (
        name.rlike(r"^\..*\.[A-Za-z0-9]{6}\z")
        | name.rlike(r"\.ocTransferId[0-9]+\.part\z")
        | name.rlike(rf"(?i)(?:{suffix})\z")
        | (name.startswith(".syncthing.") & name.endswith(".tmp"))
        | name.startswith("._")
        | name.startswith("~$")
        | (name.startswith(".siftline-") & name.endswith(".tmp"))
    )


def reject_reason(path: Column, size: Column, excluded: list[str], min_size: int, globs: list[str] | None = None) -> Column:
    """Null for what passes."""
    out = (
        F.when(in_excluded_dir(path, excluded), "excluded_dir")
        .when(is_temp_name(file_name(path)), "temp_file")
        .when(~F.coalesce(extension(path).isin(*EXTENSIONS), F.lit(False)), "not_video")
        .when(size < min_size, "too_small")
    )
    for g in globs or []:
        out = out.when(path.rlike(glob_regex(g)), "glob")
    return out


def glob_regex(glob: str) -> str:
    """A glob as a regular expression; '*' crosses '/'."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".+()[]{}^$|\\" else c) for c in glob)
    return f"^(?s:{out})\\z"


def without_opt_out(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files with no marker (root_id, dir) in their folder or one above it."""
    n = F.size(F.split("rel_path", "/"))
    above = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.split("rel_path", "/"), F.lit(1), i), "/"))
    held = files.select("id", "root_id", F.explode(above).alias("dir")).join(markers, ["root_id", "dir"], "left_semi").select("id").distinct()
    return files.join(held, "id", "left_anti")


def magic_verdict(ext: Column, head_hex: Column) -> Column:
    """match, mismatch or unchecked, from an extension and the first bytes in upper-case hex."""
    at = lambda o, n: F.substring(head_hex, 2 * o + 1, 2 * n)
    boxes = ("66747970", "6D6F6F76", "6D646174", "77696465", "66726565", "736B6970", "706E6F74")
    sync = lambda o: (at(o, 1) == "47") & (at(o + 188, 1) == "47") & (at(o + 376, 1) == "47") & (at(o + 564, 1) == "47")
    key = F.locate("060E2B34020501010D0102", head_hex)
    ok = (
        F.when(ext.isin("mp4", "m4v", "mov", "3gp", "insv"), at(4, 4).isin(*boxes))
        .when(ext.isin("mkv", "webm"), at(0, 4) == "1A45DFA3")
        .when(ext == "avi", (at(0, 4) == "52494646") & (at(8, 4) == "41564920"))
        .when(ext == "ts", sync(0))
        .when(ext.isin("mts", "m2ts"), sync(4))
        .when(ext.isin("mpg", "mpeg", "vob"), at(0, 4) == "000001BA")
        .when(ext == "wmv", at(0, 16) == "3026B2758E66CF11A6D900AA0062CE6C")
        .when(ext == "mxf", key % 2 == 1)
    )
    return F.when(ok, "match").when(~ok, "mismatch").otherwise("unchecked")
