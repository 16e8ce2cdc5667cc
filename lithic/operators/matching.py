"""Joins of calls and imports with what they mean: by name, interval, suffix, prefix and by falling back in stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import guessed_class, last_segment, path_prefixes, path_suffixes
from lithic.operators.hierarchy import tree

#: Package prefixes and the dependency that supplies them: (language, prefix, artifact, ecosystem).
SEED_RULES = [
    ("java", "org.springframework", "spring-boot-starter", "maven"), ("java", "org.springframework.boot", "spring-boot-starter", "maven"),
    ("java", "org.springframework.web", "spring-boot-starter-web", "maven"), ("java", "org.springframework.data", "spring-boot-starter-data-jpa", "maven"),
    ("java", "jakarta.persistence", "spring-boot-starter-data-jpa", "maven"), ("java", "javax.persistence", "spring-boot-starter-data-jpa", "maven"),
    ("java", "lombok", "lombok", "maven"), ("java", "org.slf4j", "slf4j-api", "maven"),
    ("java", "org.apache.commons", "commons-lang3", "maven"), ("java", "com.fasterxml.jackson", "jackson-databind", "maven"),
    ("java", "org.junit", "junit", "maven"), ("java", "org.mockito", "mockito-core", "maven"),
    ("typescript", "react", "react", "npm"), ("typescript", "react-dom", "react-dom", "npm"),
    ("typescript", "vue", "vue", "npm"), ("typescript", "@angular/core", "@angular/core", "npm"),
    ("typescript", "express", "express", "npm"), ("typescript", "koa", "koa", "npm"),
    ("typescript", "next", "next", "npm"), ("typescript", "axios", "axios", "npm"),
    ("typescript", "lodash", "lodash", "npm"), ("typescript", "typescript", "typescript", "npm"),
    ("python", "flask", "flask", "pip"), ("python", "fastapi", "fastapi", "pip"),
    ("python", "django", "django", "pip"), ("python", "sqlalchemy", "sqlalchemy", "pip"),
    ("python", "pydantic", "pydantic", "pip"), ("python", "requests", "requests", "pip"),
    ("python", "numpy", "numpy", "pip"), ("python", "pandas", "pandas", "pip"),
    ("python", "pytest", "pytest", "pip"),
]
#: Rules that hold for imports beside SEED_RULES.
IMPORT_SEED_RULES = [*SEED_RULES, ("java", "org.mybatis", "mybatis", "maven"), ("typescript", "next/navigation", "next", "npm"), ("typescript", "next/router", "next", "npm"), ("python", "uvicorn", "uvicorn", "pip"), ("python", "redis", "redis", "pip")]
#: Annotations of injected objects.
INJECTION = ("@Autowired", "@Inject", "@Resource", "@Injectable", "@Component", "@Service", "@Repository", "@Controller", "@RestController")
#: Functions that call what only the running program knows, and tags of injected parts.
DYNAMIC_CALLS = ("getattr", "setattr", "delattr", "hasattr", "__getattr__")
INJECTION_TAGS = ("dependency-injection", "spring-component", "business-service")
#: Files that a module path may stand for, in order; any other ending of the same path comes last.
MODULE_ENDINGS = ("", "/__init__.py", "/__init__.ts", "/index.ts", "/index.js", "/index.py", ".py", ".ts", ".js")


def rules(spark, rows=None) -> DataFrame:
    """Seed rules with their order; a fixed, small table."""
    listed = [(i, *r) for i, r in enumerate(rows if rows is not None else SEED_RULES)]
    return spark.createDataFrame(listed, "rule long, language string, prefix string, artifact string, ecosystem string")


def innermost(points: DataFrame, spans: DataFrame, point_keys: list[str], key: str, at: str, start: str, end: str, start_tie: str) -> DataFrame:
    """Each point with the span of its key that holds it: of several the one that ends first, then starts first. Points outside all spans stay, without span."""
    held = points.join(spans.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)), "left")
    best = Window.partitionBy(*point_keys).orderBy(F.col(end).asc_nulls_last(), F.col(start), F.col(start_tie))
    return held.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank", "__key")


def parents_by_span(nodes: DataFrame) -> DataFrame:
    """(id, parent_id): the smallest other span of the file that holds a node's span; equal spans nest by id.

    One sweep over a file's spans by start; see `hierarchy.tree`.
    """
    none = F.lit(None)
    spans = nodes.select("file_id", "id", none.cast(nodes.schema["id"].dataType).alias("parent_id"), "start_line", none.cast("int").alias("start_column"), "end_line", none.cast("int").alias("end_column"))
    return tree(spans).select("id", "parent_id")


def by_priority(candidates: DataFrame, key: str) -> DataFrame:
    """Of candidates (key, priority, ...) those of each key's smallest priority; several rows of it all stay."""
    return candidates.withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy("priority"))).where("__rank = 1").drop("__rank")


def suffix_matches(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls `obj.method` with functions whose qualified name ends in `.method` and holds the class that obj suggests.

    The last segment makes it a hash join; the rest is a filter on its rows.
    """
    method, owner = last_segment(F.col("qualified_name")), guessed_class(F.col("qualified_name"))
    named = calls.withColumns({"__method": method, "__class": owner}).where("__class is not null")
    targets = functions.select(F.col("id").alias("callee_node_id"), F.col("qualified_name").alias("__target"), last_segment(F.col("qualified_name")).alias("__method"))
    return named.join(targets, "__method").where(F.col("__target").contains(F.col("__class"))).drop("__method", "__class", "__target")


def narrowed(matches: DataFrame, key: str, fits: Column) -> DataFrame:
    """Of each key's matches those that fit, or all of them if none does."""
    any_fits = F.max(fits.cast("int")).over(Window.partitionBy(key))
    return matches.withColumn("__any", any_fits).where(fits | (F.coalesce("__any", F.lit(0)) == 0)).drop("__any")


def prefix_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_id: str, right_id: str, separator: str = ".") -> DataFrame:
    """(left_id, right_id, exact): the first right row whose key equals the left one or, failing that, is a dotted prefix of it or has it as one.

    Keys are compared in lower case; prefixes are exploded, so that all is hash joins.
    """
    parts = lambda c: path_prefixes(F.replace(F.lower(c), F.lit(separator), F.lit("/")))
    whole = lambda c: F.replace(F.lower(c), F.lit(separator), F.lit("/"))
    a = left.select(F.col(left_id), whole(F.col(left_key)).alias("__l"), parts(F.col(left_key)).alias("__lp"))
    b = right.select(F.col(right_id), whole(F.col(right_key)).alias("__r"), parts(F.col(right_key)).alias("__rp"))
    down = a.withColumn("__k", F.explode("__lp")).join(b.withColumn("__k", F.col("__r")), "__k").select(left_id, right_id, (F.col("__l") == F.col("__r")).alias("exact"))
    up = b.withColumn("__k", F.explode("__rp")).join(a.withColumn("__k", F.col("__l")), "__k").select(left_id, right_id, (F.col("__l") == F.col("__r")).alias("exact"))
    best = Window.partitionBy(left_id).orderBy(F.desc("exact"), right_id)
    return down.union(up).withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def resolved_paths(imports: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Imports with imported_file_id: the first of the module path's possible files that exists, or a file with another ending.

    Files are listed under the module paths they may stand for, so imports are shuffled once, as they are. The join is
    hinted: its sides may be far larger than the files from which Spark estimates them.
    """
    whole = F.col("path")
    bases = [F.when(whole.endswith(e), F.left(whole, F.length(whole) - len(e))) for e in MODULE_ENDINGS]
    stands = files.select("file_id", F.posexplode(F.array(*bases, F.regexp_replace("path", r"\.[^./]+$", ""))).alias("__at", "__base")).where("__base is not null")
    best = stands.groupBy("__base").agg(F.min_by("file_id", F.struct("__at", F.col("file_id").isNull(), "file_id")).alias("imported_file_id"))
    return imports.join(best.hint("merge"), F.col(path) == F.col("__base"), "left").drop("__base")


#: Beginnings of import names that stand for the source folder, and endings that are tried, in order.
ALIASES = ("@/", "~/", "@app/", "@src/")
ALIAS_ENDINGS = (".ts", ".tsx", ".vue", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.vue", "/index.js", "/index.jsx")


def aliased_path(name: Column) -> Column:
    """An import's name without its alias, or without one leading ./ and one ../."""
    bare = F.coalesce(*(F.when(F.startswith(name, F.lit(a)), F.substring(name, len(a) + 1, 1 << 30)) for a in ALIASES), name)
    return F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), r"^\.\./", "")


def resolved_aliases(imports: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """`imports` with imported_file_id: the file (path, file_id) that a name of the bundler's kind stands for, null if none.

    A name with a known ending is tried as it is, another with each of ALIAS_ENDINGS. First whole paths in that order;
    then, for each candidate, a file whose path ends in it at a folder's border, and the same behind src/. Of several
    files with an ending one whose whole path it is comes first, then the first by path. Candidates and endings of
    paths meet in hash joins of distinct names, so a name that very many imports have is resolved once.
    """
    path = aliased_path(F.col("__name"))
    known = reduce(Column.__or__, (F.endswith(path, F.lit(e)) for e in ALIAS_ENDINGS))
    tried = F.when(known, F.array(path)).otherwise(F.array(*(F.concat(path, F.lit(e)) for e in ALIAS_ENDINGS)))
    names = imports.select(F.col(name).alias("__name")).where("__name is not null").distinct()
    candidates = names.select("__name", F.posexplode(tried).alias("__at", "__path"))
    n = len(ALIAS_ENDINGS)
    clean = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "file_id")
    exact = candidates.join(files.select(F.col("path").alias("__path"), "file_id"), "__path").select("__name", F.col("__at").alias("__rank"), "file_id")
    tails = clean.select("path", "file_id", F.posexplode(path_suffixes(F.col("path"))).alias("__k", "__path"))
    first = tails.groupBy("__path").agg(F.min_by("file_id", F.struct((F.col("__k") > 0).alias("part"), "path")).alias("file_id"))
    behind = candidates.select("__name", F.explode(F.array(F.struct((n + 2 * F.col("__at")).alias("r"), F.col("__path").alias("p")), F.struct((n + 1 + 2 * F.col("__at")).alias("r"), F.concat(F.lit("src/"), "__path").alias("p")))).alias("c"))
    ending = behind.select("__name", F.col("c.r").alias("__rank"), F.col("c.p").alias("__path")).join(first, "__path").select("__name", "__rank", "file_id")
    best = exact.union(ending).groupBy("__name").agg(F.min_by("file_id", "__rank").alias("imported_file_id"))
    return imports.join(best, F.col(name) == F.col("__name"), "left").drop("__name")


def import_kind(name: Column, resolved: Column) -> Column:
    """external if nothing was found, relative if the name starts with a dot, else absolute."""
    return F.when(resolved.isNull(), "external").when(name.startswith("."), "relative").otherwise("absolute")


def files_of_paths(nodes: DataFrame, files: DataFrame, absolute: str) -> DataFrame:
    """Nodes with the file whose relative path ends their absolute path; of several the longest."""
    tails = nodes.select("id", F.posexplode(path_suffixes(F.replace(F.col(absolute), F.lit("\\"), F.lit("/")))).alias("__at", "path"))
    best = tails.join(files.select("path", "file_id"), "path").groupBy("id").agg(F.min_by("file_id", "__at").alias("file_id"))
    return nodes.drop("file_id").join(best, "id", "left")


def dependency_keys(deps: DataFrame) -> DataFrame:
    """(key, ...): the names under which a dependency may be imported, in lower case."""
    group, artifact = F.lower("group_name"), F.lower("artifact_name")
    return deps.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(artifact, F.concat_ws("/", group, artifact), group)))))
