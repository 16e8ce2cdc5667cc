"""Which external dependency an import or a call stands for: declared ones first, then seed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.operators.matching import IMPORT_SEED_RULES, SEED_RULES, dependency_keys, prefix_matches

#: Language, endings of its files, and what separates the segments of its imports.
LANGUAGES = (("java", (".java", ".kt"), "."), ("typescript", (".ts", ".tsx", ".js", ".jsx", ".vue"), "/"), ("python", (".py",), "."))


def _by_language(path: Column, of) -> Column:
    """of(language, separator, rules) for the language of a file; null for other files."""
    out = F.lit(None).cast("string")
    for language, endings, separator in reversed(LANGUAGES):
        fits = F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(path, e))
        out = F.when(fits, of(language, separator)).otherwise(out)
    return out


def _first(rules, language: str, fits) -> Column:
    """Artifact of the first rule of a language that fits; the rules are a fixed list, so this is one expression."""
    named = [F.when(fits(prefix.lower()), F.lit(artifact)) for own, prefix, artifact, _ in rules if own == language]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def bare_import(name: Column) -> Column:
    """An import's name without spaces and quotes around it."""
    return F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", "")


def seeded_import(name: Column, path: Column, rules=None) -> Column:
    """Dependency of an import by seed rules of its file's language; null if none fits.

    Java names begin with the rule's prefix; others equal it or go on with their separator.
    """
    lower = F.lower(bare_import(name))

    def of(language: str, separator: str) -> Column:
        whole = lambda p: (lower == p) | F.startswith(lower, F.lit(p + separator))
        return _first(rules or IMPORT_SEED_RULES, language, (lambda p: F.startswith(lower, F.lit(p))) if language == "java" else whole)

    return _by_language(path, of)


def seeded_object(name: Column, path: Column, rules=None) -> Column:
    """Dependency of an object by seed rules: the first whose last segment is the object's name."""
    lower = F.lower(F.trim(name))
    return _by_language(path, lambda language, separator: _first(rules or SEED_RULES, language, lambda p: lower == p.rsplit(separator, 1)[-1]))


def declared_imports(imports: DataFrame, deps: DataFrame) -> DataFrame:
    """(name, dep): distinct names of `imports` (name) with the declared dependency (number, group_name, artifact_name) they stand for.

    A key of a dependency equals the name or one is a dotted prefix of the other; equal ones first, then by number.
    """
    keys = dependency_keys(deps).select("key", "number", "artifact_name")
    found = prefix_matches(imports.select("name").where("name <> ''").distinct(), keys, "name", "key", "name", "number")
    return found.join(deps.select("number", F.col("artifact_name").alias("dep")), "number").select("name", "dep")


def external_calls(calls: DataFrame, imports: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, external): `dependency.method` of calls (id, file_id, file_path, qualified_name, method) on an imported object.

    The first import (file_id, name, number) of the file whose last segment is the object's name and that stands for a
    declared dependency decides, else the seed rules; calls without either are left out, as are those without an object.
    """
    named = imports.withColumn("name", bare_import(F.col("name")))
    known = named.join(declared_imports(named, deps), "name")
    tail = F.lower(F.substring_index(F.replace("name", F.lit("/"), F.lit(".")), ".", -1))
    first = known.groupBy("file_id", tail.alias("__object")).agg(F.min_by("dep", F.struct("number", "name")).alias("__dep"))
    objects = calls.where(F.contains("qualified_name", F.lit(".")) & F.col("file_id").isNotNull())
    objects = objects.withColumn("__object", F.lower(F.trim(F.substring_index("qualified_name", ".", 1)))).where("__object <> ''")
    dep = F.coalesce("__dep", seeded_object(F.col("__object"), F.coalesce("file_path", F.lit(""))))
    return objects.join(first, ["file_id", "__object"], "left").withColumn("__dep", dep).where("__dep is not null").select("id", F.concat_ws(".", "__dep", "method").alias("external"))
