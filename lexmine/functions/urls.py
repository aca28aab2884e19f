"""URL parts and joining by plain expressions. The built-in parser gives NULL for URLs with a space; these do not."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def host(url: Column) -> Column:
    """Authority part, as written."""
    return F.regexp_extract(_tidy(url), rf"{_SCHEME}//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    whole = F.regexp_extract(_tidy(url), rf"{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def _resolve_dots(parts: Column) -> Column:
    size = F.size(parts)
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda s: s != "")
    tidy = F.when(size < 2, parts).otherwise(F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1)))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(tidy, none, step)
    kept = F.when(_last(tidy).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    # Going up past the top drops the leading empty part.
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def join(base: Column, link: Column) -> Column:
    """Resolve a link against the URL of its page."""
    base, link = _tidy(base), _tidy(link)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    base_path = F.regexp_extract(base, rf"{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.split(base_path, "/", -1)
    folder = F.when(_last(folder) != "", F.slice(folder, F.lit(1), F.size(folder) - 1)).otherwise(folder)
    own = F.split(link_path, "/", -1)
    parts = F.when(link.startswith("/"), own).otherwise(F.concat(folder, own))
    without_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(without_fragment, link))
        .when(link.startswith("?"), F.concat(site, base_path, link))
        .otherwise(F.concat(site, _resolve_dots(parts), tail))
    )
