"""String, hash and array expressions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of a text, lower-case hex."""
    return F.sha2(text, 256)


def fingerprint(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, joined by newlines; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32)


def line_count(text: Column) -> Column:
    """Lines of a text; a last line without newline counts, an empty text has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def last_segment(text: Column, separator: str = ".") -> Column:
    return F.substring_index(text, separator, -1)


def guessed_class(call: Column) -> Column:
    """Class that a call's object suggests: `userService.save` and `this.userService.save` give UserService; null for `this.save` and plain names."""
    first = F.trim(F.substring_index(call, ".", 1))
    named = F.when((first == "this") & (F.size(F.split(call, r"\.")) >= 3), F.trim(F.split_part(call, F.lit("."), F.lit(2)))).otherwise(first)
    pascal = F.concat(F.upper(F.substring(named, 1, 1)), named.substr(F.lit(2), F.length(named)))
    return F.when(call.contains(".") & (named != "this") & (named != "self") & (named != "*"), pascal)


def call_name(raw: Column) -> Column:
    """Calls on any object lose it: `a.b.m` becomes `*.m`; `new X` stays."""
    return F.when(raw.startswith("new "), raw).when(raw.contains("."), F.concat(F.lit("*."), last_segment(raw))).otherwise(raw)


def import_name(raw: Column) -> Column:
    """An import's name without quotes and alias."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), "^[\"']|[\"'];?$", ""), r"\s+as\s+\S+$", ""))


def module_path(name: Column) -> Column:
    """Dotted module names as paths; names with a slash keep it, backslashes are turned."""
    turned = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.when(turned.contains("/"), turned).otherwise(F.replace(turned, F.lit("."), F.lit("/")))


def collapsed_path(path: Column) -> Column:
    """A path without `.` and with `..` applied; more `..` than folders leave none."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def path_prefixes(path: Column) -> Column:
    """All leading folders of a slashed path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def path_suffixes(path: Column) -> Column:
    """The path and all that is left of it as leading folders go, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def url_path(url: Column) -> Column:
    """Path of a URL: no scheme, host, query, fragment or slash at either end."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return F.btrim(bare, F.lit("/"))


def route_pattern(path: Column) -> Column:
    """Parameters of a route in braces: `:id` and `<int:id>` become `{id}`."""
    return F.regexp_replace(F.regexp_replace(path, r"<(?:\w+:)?(\w+)>", "{$1}"), r"(^|/):(\w+)", "$1{$2}")


def abbreviated_path(path: Column, most: int) -> Column:
    """The longest tail of a path's parts that fits `most` characters, marked by `.../` if parts are gone."""
    tails = path_suffixes(path)
    fitting = F.try_element_at(F.filter(tails, lambda t: F.length(t) <= most), F.lit(1))
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit(".../"), F.coalesce(fitting, last_segment(path, "/"))))


def truncated_at_line(text: Column, most: int) -> Column:
    """At most `most` characters; a cut text ends with its last whole line if it has one."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(cut, "\n[^\n]*\\z", ""))


def first_match(text: Column, patterns: dict[str, str], default: str) -> Column:
    """Value of the first pattern, in order, that the lower-cased text contains."""
    low = F.lower(text)
    chain = reduce(lambda c, kv: F.when(low.contains(kv[0]), kv[1]) if c is None else c.when(low.contains(kv[0]), kv[1]), patterns.items(), None)
    return chain.otherwise(default)


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))


def appended(existing: Column, new: Column) -> Column:
    """Tags with new ones behind, none twice; null counts as none."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(existing, none), F.coalesce(new, none))


def version_tag(at: Column, commit: Column) -> Column:
    return F.concat(F.lit("v"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.substring(commit, 1, 8))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def naming(name: Column) -> Column:
    """hook, component or other by a function's name."""
    return F.when(name.rlike("^use[A-Z]"), "hook").when(name.rlike("^[A-Z]"), "component").otherwise("other")
