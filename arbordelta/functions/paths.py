"""Column helpers for paths, modes and hashes; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbordelta.schema import DIR_BIT, LINK_BIT, PERMISSION_BITS


def slash_prefixes(path: Column) -> Column:
    """Every prefix of the path that ends in a slash, the path itself if it does."""
    parts = F.split(path, "/", -1)
    counts = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    joined = F.transform(counts, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, joined).otherwise(F.array().cast("array<string>"))


def covering_keys(path: Column) -> Column:
    """The paths whose tombstone is needless once this path is written.

    The path itself, each directory above it, and each of these as a file.
    """
    above = slash_prefixes(path)
    return F.array_distinct(F.concat(F.array(path), above, F.transform(above, lambda d: F.left(d, F.length(d) - 1))))


def retired_keys(path: Column) -> Column:
    """The paths that a write of this path closes: itself and the directories above it."""
    return F.array_distinct(F.concat(F.array(path), slash_prefixes(path)))


def starts_with_any(path: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.startswith(p) for p in prefixes), F.lit(False))


def starts_with_all(path: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (path.startswith(p) for p in prefixes), F.lit(True))


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(DIR_BIT) != 0


def is_link(mode: Column) -> Column:
    return mode.bitwiseAND(LINK_BIT) != 0


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(PERMISSION_BITS)


def kind(mode: Column, packed: Column) -> Column:
    """pack, directory, symlink or file."""
    return F.when(packed, "pack").when(is_dir(mode), "directory").when(is_link(mode), "symlink").otherwise("file")


def pack_parent(path: Column, patterns: Column) -> Column:
    """The shortest of the path's directories that a pattern is found in, else null.

    A slash is put after the last component too, so a file can be its own parent.
    """
    full = F.concat(path, F.lit("/"))
    return F.try_element_at(
        F.filter(slash_prefixes(full), lambda d: F.coalesce(F.exists(patterns, lambda p: F.regexp(d, p)), F.lit(False))), F.lit(1))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob whose stars cross slashes.

    Knows *, **, ?, [abc], [!abc], {a,b} and backslash escapes.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i:i + 1] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, include: str | None, exclude: str | None) -> Column:
    taken = path.rlike(glob_pattern(include)) if include else F.lit(True)
    return taken & ~path.rlike(glob_pattern(exclude)) if exclude else taken


def content_hash(content: Column) -> Column:
    """SHA-256 in lower-case hexadecimal; null counts as empty."""
    return F.sha2(F.coalesce(content, F.lit(b"")), 256)
