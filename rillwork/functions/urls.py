"""URLs as columns: resolving relative ones, inheriting query keys, and an identity that ignores some keys.

A null URL gives null.  Keys and values of a query are compared decoded and
written encoded, a space as ``+``; what can't be decoded is taken as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _WHOLE, k)


def _pairs(query: Column) -> Column:
    """(k, v) structs of a query without its question mark, decoded, in order."""
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    return F.transform(pieces, lambda p: F.struct(decoded(key(p)).alias("k"), decoded(value(p)).alias("v")))


def _written(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _query(url: Column) -> Column:
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def identity_url(url: Column, ignored: tuple[str, ...]) -> Column:
    """The URL without the ignored query keys and without fragment, its other pairs sorted; as it is if it has a query and no such key."""
    pairs = _pairs(_query(url))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*ignored)))
    base = F.regexp_replace(url, r"(?s)[?#].*$", "")
    plain = (F.size(kept) == F.size(pairs)) & (_part(url, 4) != "")
    return F.when(url.isNull(), None).when(plain, url).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), _written(kept)))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..``; going up from the root stays there."""
    steps = F.split(path, "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    last = F.element_at(steps, -1)
    return F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved_url(base: Column, relative: Column) -> Column:
    """A relative URL against its base: other hosts, absolute and relative paths, queries or fragments alone; an empty one is the base without fragment.

    Null if either is null and the relative one isn't absolute.
    """
    scheme, host = F.concat(_part(base, 1), F.lit(":")), F.concat(F.lit("//"), _part(base, 2))
    path, query, fragment = _part(relative, 3), _part(relative, 4), _part(relative, 5)
    own = F.when(_part(base, 3) == "", "/").otherwise(_part(base, 3))
    folder = F.regexp_replace(own, "[^/]*$", "")
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    joined = F.when(path == "", F.concat(own, F.when(query == "", _part(base, 4)).otherwise(query))).otherwise(F.concat(_without_dots(absolute), query))
    return (
        F.when(_part(relative, 1) != "", relative)
        .when(base.isNull() | relative.isNull(), None)
        .when(relative.startswith("//"), F.concat(scheme, F.lit("//"), _part(relative, 2), F.when(path == "", "/").otherwise(_without_dots(path)), query, fragment))
        .otherwise(F.concat(scheme, host, joined, fragment))
    )


def inherited_query(url: Column, parent: Column) -> Column:
    """The URL with those pairs of the parent's query whose keys it lacks behind its own; of a repeated key the first.

    A null or empty parent query changes nothing.
    """
    own = F.transform(_pairs(_query(url)), lambda p: p["k"])
    start = F.array().cast("array<struct<k:string,v:string>>")
    new = F.aggregate(F.filter(_pairs(F.coalesce(parent, F.lit(""))), lambda p: ~F.array_contains(own, p["k"])), start, lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.array_append(acc, p)))
    base, fragment, query = F.regexp_replace(url, r"(?s)[?#].*$", ""), _part(url, 5), _query(url)
    added = F.concat(base, F.lit("?"), query, F.when(query == "", "").otherwise("&"), _written(new), fragment)
    return F.when(url.isNull(), None).when(F.size(new) == 0, url).otherwise(added)
