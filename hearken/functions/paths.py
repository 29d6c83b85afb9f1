"""Audio path handling on path strings; no file is touched."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearken.runtime import ColumnLike, as_column


def prefix_path(path: ColumnLike, root: str) -> Column:
    """`root/` in front of a relative path."""
    return F.concat(F.lit(root.rstrip("/") + "/"), as_column(path))


def rebase_path(path: ColumnLike, folder: str) -> Column:
    """Keep the file name only and put it under `folder`. A null path stays null."""
    path = as_column(path)
    parts = F.array_remove(F.array_remove(F.split(path, "/"), ""), ".")
    moved = F.concat_ws("/", F.lit(folder.rstrip("/")), F.try_element_at(parts, F.lit(-1)))
    return F.when(path.isNotNull(), moved)


def absolute_path(path: ColumnLike, cwd: str) -> Column:
    """Absolute form of a path seen from `cwd`, with `.`, `..` and repeated slashes folded."""
    path = as_column(path)
    full = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(cwd.rstrip("/") + "/"), path)
    )
    parts = F.array_remove(F.array_remove(F.split(full, "/"), ""), ".")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.concat(kept, F.array(part))),
    )
    # POSIX keeps exactly two leading slashes apart from one
    root = F.when(full.rlike("^//[^/]"), "//").otherwise("/")
    rebuilt = F.concat(root, F.array_join(folded, "/"))
    # most paths need no folding and skip the interpreted lambda
    return F.when(full.rlike(r"/\.{0,2}(/|$)"), rebuilt).otherwise(full)


# a scheme of two letters or more, an authority if there is one, and an absolute path
_URI = r"^([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)$"


def canonical_path(path: ColumnLike, base: str = "/") -> Column:
    """One form for all spellings of a path, so that paths can be compared.

    A relative path is seen from `base`. `file:/a`, `file:///a` and `/a` are `/a`; of other
    schemes, scheme and authority stay, in lower case. Percent codes in a URI become their
    characters (a path without scheme may hold a literal `%`); `.`, `..` and repeated slashes
    are folded. Null stays null.
    """
    path = as_column(path)
    scheme = F.lower(F.regexp_extract(path, _URI, 1))
    authority = F.lower(F.regexp_extract(path, _URI, 2))
    inside = F.regexp_extract(path, _URI, 3)
    # a plus sign is no space in a path; a broken code stays as it is
    decoded = F.coalesce(F.try_url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))), inside)
    is_uri = path.rlike(_URI)
    front = F.when(is_uri & (scheme != "file"), F.concat(scheme, F.lit("://"), authority))
    plain = F.when(is_uri, decoded).otherwise(path)
    folded = absolute_path(F.regexp_replace(plain, "^/+", "/"), base)
    return F.concat(F.coalesce(front, F.lit("")), folded)
