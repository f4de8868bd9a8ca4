"""Path columns: names, folders and extension tests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_scheme(path: Column) -> Column:
    """``file:/a/b`` and ``file:///a/b`` become ``/a/b``; other paths are unchanged."""
    return F.regexp_replace(path, r"^file:/+", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_below(path: Column, root: str) -> Column:
    """Directory of ``path`` with every occurrence of ``root`` removed and no leading slash."""
    directory = F.rtrim(F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path))), F.lit("/"))
    if root:
        directory = F.replace(directory, F.lit(root), F.lit(""))
    return F.ltrim(directory, F.lit("/"))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Case-insensitive suffix test for any of ``extensions`` (given without the dot)."""
    lowered = F.lower(path)
    test = F.lit(False)
    for extension in extensions:
        test = test | lowered.endswith("." + extension.lower())
    return test


def extension_glob(extensions: Sequence[str]) -> str:
    """File-name glob for ``pathGlobFilter`` that accepts any letter case."""
    spelled = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    return "*.{" + ",".join(spelled) + "}"


def extension_pattern(extensions: Sequence[str]) -> str:
    """The same names as `extension_glob`, as a pattern of Python."""
    spelled = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in e) for e in extensions)
    return r".*\.(" + "|".join(spelled) + ")"


def matches_any_term(folder: Column, terms: Sequence[str]) -> Column:
    """Folder contains any of ``terms`` as a substring, ignoring case; NULL and "" never match."""
    lowered = F.lower(folder)
    test = F.lit(False)
    for term in terms:
        test = test | lowered.contains(term.lower())
    return F.coalesce(test & (folder != ""), F.lit(False))
