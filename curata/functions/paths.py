"""Paths and URLs as column functions: a fold over the components, with those that are open as a stack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    """Components from the root or the working folder on: ``.`` and empty ones are skipped, ``..`` closes the one before."""
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        up = F.when((F.size(stack) > 0) & (F.element_at(stack, -1) != ".."), F.slice(stack, 1, F.size(stack) - 1))
        up = up.when(absolute, stack).otherwise(F.array_append(stack, F.lit("..")))  # above the root is the root
        return F.when((part == "") | (part == "."), stack).when(part == "..", up).otherwise(F.array_append(stack, part))

    return F.aggregate(F.split(path, "/"), none, step)


def normpath(path: Column) -> Column:
    """The path without ``.``, ``..`` that can be resolved by name, and repeated or last slashes; ``.`` if nothing is left."""
    out = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(_parts(path), "/"))
    return F.when(out == "", ".").otherwise(out)


def relpath(path: Column, start: Column) -> Column:
    """The path as seen from a folder, both from the root or both from the working folder; null if they differ in that."""
    a, b = _parts(path), _parts(start)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, False)
    shared = F.when(F.size(same) == 0, 0).when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0))))
    return F.when(path.startswith("/") == start.startswith("/"), F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash, without slashes at its end unless it is nothing else."""
    head = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    return F.when(head.rlike("^/*$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def extension(path: Column) -> Column:
    """From the last dot of the base name on; a name that only begins with dots has none."""
    return F.regexp_extract(F.regexp_replace(basename(path), r"^\.+", ""), r"(\.[^.]*)$", 1)


def url_path(url: Column) -> Column:
    """The normal path of a URL: without scheme, host, query and fragment, and with its percent signs decoded."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    return normpath(F.concat(F.lit("/"), plain))
