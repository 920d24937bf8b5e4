"""Identity helpers on columns: canonical ids, short names, owners, path patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLISION = "#symbol"


def canonical_id(id: Column) -> Column:
    return F.regexp_replace(id, "#symbol$", "")


def short_name(id: Column) -> Column:
    return F.substring_index(id, "/", -1)


def member_owner(id: Column) -> Column:
    """``pkg.Recv`` of ``pkg.(Recv).Name``; null for other ids."""
    package, owner = (F.regexp_extract(id, r"^(.*?)\.\(([^)]+)\)\.", k) for k in (1, 2))
    return F.when(owner != "", F.concat(package, F.lit("."), owner))


def utf16_key(id: Column) -> Column:
    """Sort key of UTF-16 code units."""
    return F.encode(id, "UTF-16BE")


def abbreviated(spelling: Column) -> Column:
    """Whether a type spelling was cut and ends in the digest of the whole."""
    return spelling.rlike("sha256:[0-9a-f]{64}$")


def module_relative(path: Column, module: Column) -> Column:
    """``.`` for the module, the rest behind ``module/``, any other path as it is."""
    below = path.startswith(F.concat(module, F.lit("/")))
    return F.when(path == module, ".").when((module != "") & below, F.substring(path, F.length(module) + 2, F.length(path))).otherwise(path)


def validate_pattern(pattern: str) -> None:
    """Raise on what path patterns do not allow."""
    if not pattern or re.search(r"[?\[\]{}\\]", pattern):
        raise ValueError(f"pattern holds a character without meaning: {pattern!r}")
    parts = pattern.split("/")
    for k, part in enumerate(parts):
        if not part:
            raise ValueError(f"empty segment in pattern: {pattern!r}")
        if part == "**":
            if k != len(parts) - 1 or k == 0:
                raise ValueError(f"** must end a pattern after a path: {pattern!r}")
            if any("*" in x for x in parts[:-1]):
                raise ValueError(f"* before /** in pattern: {pattern!r}")
        elif part.count("*") > 1:
            raise ValueError(f"more than one * in a segment: {pattern!r}")


def match_path(pattern: str, path: Column) -> Column:
    """Exact path, ``x/**`` (x and all below) or one ``*`` a segment."""
    if pattern.endswith("/**"):
        base = pattern[:-3]
        return (path == base) | path.startswith(base + "/")
    if "*" not in pattern:
        return path == pattern
    return path.rlike("^" + "/".join("[^/]*".join(re.escape(x) for x in p.split("*")) for p in pattern.split("/")) + r"\z")


def match_file(pattern: str, relative: Column) -> Column:
    """``!`` negates; a pattern without ``/`` goes by the file name."""
    if pattern.startswith("!"):
        return ~match_file(pattern[1:], relative)
    return match_path(pattern, relative if "/" in pattern else F.substring_index(relative, "/", -1))


def excluded(patterns: list[str], relative: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | match_path(p, relative)
    return out


def significant(x: Column, digits: int = 3) -> Column:
    """Shortest form with ``digits`` significant digits, exponents below 1e-4."""
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int"))
    scale = F.pow(F.lit(10.0), places)
    rounded = F.format_string("%.12f", F.round(x * scale) / scale)
    plain = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}e", x), r"0+e", "e"), r"\.e", "e")
    return F.when(x == 0, "0").when(F.abs(x) < 1e-4, mantissa).otherwise(plain)


def round3(x: Column) -> Column:
    return F.round(x * 1000) / 1000


def portable_file(file: Column, root: str) -> Column:
    """A file as a committed baseline names it: relative to ``root`` where it lies inside, else its bare name.

    Relative files count as relative to the root; one that climbs out of it, or starts at
    the root of any system, keeps its name alone.
    """
    inner = file
    if base := root.rstrip("/"):
        inner = F.when(file.startswith(base + "/"), F.substring(file, len(base) + 2, 1 << 30)).otherwise(file)
    clean = F.regexp_replace(F.regexp_replace(inner, r"/(\./)+|//+", "/"), r"^(\./)+", "")
    outside = clean.rlike(r"^([/\\]|[A-Za-z]:)") | clean.rlike(r"(^|/)\.\.(/|$)") | clean.isin("", ".")
    return F.when(outside, F.regexp_extract(file, r"([^/\\]*)$", 1)).otherwise(clean)


def portable_position(position: Column, root: str) -> Column:
    return F.when(position.isNotNull(), F.struct(portable_file(position["file"], root).alias("file"), position["line"].alias("line"), position["column"].alias("column")))
