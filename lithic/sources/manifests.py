"""External dependencies from manifests: (path, ecosystem, group_name, artifact_name, version, version_range, scope, at)."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators.registry import Registry

#: Ecosystems of manifests.
ECOSYSTEMS = {
    "pom.xml": "maven", "build.gradle": "maven", "build.gradle.kts": "maven", "package.json": "npm", "requirements.txt": "pip",
    "pyproject.toml": "pip", "Pipfile": "pip", "go.mod": "go", "Cargo.toml": "cargo",
}
#: Scopes of Gradle configurations and of package.json and Cargo.toml sections.
GRADLE_SCOPES = {"implementation": "compile", "api": "compile", "compileOnly": "runtime", "runtimeOnly": "runtime", "testImplementation": "test", "testCompileOnly": "test", "testRuntimeOnly": "test"}
NPM_SECTIONS = {"dependencies": "compile", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "runtime"}
CARGO_SECTIONS = {"dependencies": "compile", "dev-dependencies": "dev", "build-dependencies": "runtime"}
_SCHEMA = "path string, group_name string, artifact_name string, version_range string, scope string, at int"
_OUT = ["path", "ecosystem", "group_name", "artifact_name", "version", "version_range", "scope", "at"]


def ecosystem(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ECOSYSTEMS.items() for x in kv))
    return F.try_element_at(names, F.substring_index(path, "/", -1))


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.substring_index("path", "/", -1).isin(*names))


def _empty_as_null(c: Column) -> Column:
    return F.when(c != "", c)


def _stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _finish(rows: DataFrame, eco: str, version: Column) -> DataFrame:
    return rows.withColumns({"ecosystem": F.lit(eco), "version": version}).select(*_OUT)


def pom(files: DataFrame) -> DataFrame:
    """Maven: each <dependency> outside of comments; scope compile unless named."""
    bare = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    blocks = _named(files, "pom.xml").select("path", F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)<(?:\w+:)?dependency>(.*?)</(?:\w+:)?dependency>"), F.lit(1))).alias("at", "b"))
    tag = lambda n: _empty_as_null(_stripped(F.regexp_extract("b", rf"(?s)<(?:\w+:)?{n}>(.*?)</(?:\w+:)?{n}>", 1)))
    rows = blocks.select("path", tag("groupId").alias("group_name"), tag("artifactId").alias("artifact_name"), tag("version").alias("version_range"), F.coalesce(tag("scope"), F.lit("compile")).alias("scope"), "at")
    return _finish(rows.where("artifact_name is not null"), "maven", F.col("version_range"))


def gradle(files: DataFrame) -> DataFrame:
    """Gradle: quoted `group:artifact[:version]` of known configurations; a part never reaches past its quotes."""
    pattern = rf"({'|'.join(GRADLE_SCOPES)})\s+['\"]([^:'\"]+):([^:'\"]+):?([^'\"]*)['\"]"
    part = lambda g: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))
    each = _named(files, "build.gradle", "build.gradle.kts").select("path", F.posexplode(F.arrays_zip(part(1).alias("c"), part(2).alias("g"), part(3).alias("a"), part(4).alias("v"))).alias("at", "d"))
    scopes = F.create_map(*(F.lit(x) for kv in GRADLE_SCOPES.items() for x in kv))
    rows = each.select("path", F.col("d.g").alias("group_name"), F.col("d.a").alias("artifact_name"), _empty_as_null(F.col("d.v")).alias("version_range"), F.element_at(scopes, F.col("d.c")).alias("scope"), "at")
    return _finish(rows, "maven", F.col("version_range"))


def npm(files: DataFrame) -> DataFrame:
    """package.json: four sections; `@scope/name` has the scope as group."""
    read = F.from_json("content", ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS))
    parsed = _named(files, "package.json").select("path", read.alias("j"))

    def section(name: str, scope: str) -> Column:
        entries = F.map_entries(F.coalesce(F.col("j")[name], F.create_map().cast("map<string,string>")))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("n"), e["value"].alias("v"), F.lit(scope).alias("s")))

    sections = [section(*s) for s in NPM_SECTIONS.items()]
    each = parsed.select("path", F.posexplode(F.concat(*sections)).alias("at", "d"))
    scoped = F.col("d.n").startswith("@") & F.col("d.n").contains("/")
    rows = each.select("path", F.when(scoped, F.substring_index("d.n", "/", 1)).alias("group_name"), F.when(scoped, F.substring_index("d.n", "/", -1)).otherwise(F.col("d.n")).alias("artifact_name"), F.col("d.v").alias("version_range"), F.col("d.s").alias("scope"), "at")
    exact = F.when(F.col("version_range").rlike(r"^\d"), F.col("version_range"))
    return _finish(rows, "npm", exact)


def requirement(text: Column) -> Column:
    """struct(name, spec) of a requirement `name[extras] spec; marker`, null if it is none."""
    body = F.trim(F.regexp_replace(text, r"\s*(;.*)?$", ""))
    pattern = r"^([a-zA-Z0-9_.-]+)(?:\[[^\]]+\])?\s*((?:[<>=!~]=?=?.*)?)$"
    return F.when(body.rlike(pattern), F.struct(F.regexp_extract(body, pattern, 1).alias("name"), _empty_as_null(F.trim(F.regexp_extract(body, pattern, 2))).alias("spec")))


def pinned(spec: Column) -> Column:
    """The version that `==` names."""
    return _empty_as_null(F.regexp_extract(spec, r"==\s*([\w.]+)", 1))


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: lines `name spec`; comments, options and lines with extras are skipped."""
    lines = _named(files, "requirements.txt").select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    clean = lines.withColumn("line", _stripped(F.regexp_replace("line", "#.*$", ""))).where("line <> '' and not startswith(line, '-') and not contains(line, '[')")
    rows = clean.withColumn("r", requirement(F.col("line"))).where("r is not null").select("path", F.lit(None).cast("string").alias("group_name"), F.col("r.name").alias("artifact_name"), F.col("r.spec").alias("version_range"), F.lit("compile").alias("scope"), "at")
    return _finish(rows, "pip", pinned(F.col("version_range")))


def go_mod(files: DataFrame) -> DataFrame:
    """go.mod: require lines and blocks; an indirect requirement is left out on a single line and kept in a block."""
    lines = _named(files, "go.mod").select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "raw")).withColumn("line", _stripped(F.col("raw")))
    opened = F.col("line").rlike(r"^require\s*\(").cast("int") - ((F.col("line") == ")")).cast("int")
    order = Window.partitionBy("path").orderBy("at")
    marked = lines.withColumn("open", F.greatest(F.lit(0), F.sum(opened).over(order))).where(~F.col("line").rlike(r"^require\s*\(") & (F.col("line") != ")"))
    single = F.col("line").rlike(r"^require\s+\S+\s+v") & ~F.col("line").contains("// indirect")
    inside = (F.col("open") > 0) & F.col("line").rlike(r"^\S+\s+v")
    body = F.regexp_replace("line", r"^require\s+", "")
    rows = marked.where(single | inside).select("path", F.lit(None).cast("string").alias("group_name"), F.regexp_extract(body, r"^(\S+)", 1).alias("artifact_name"), F.regexp_extract(body, r"^\S+\s+(\S+)", 1).alias("version_range"), F.lit("compile").alias("scope"), "at")
    return _finish(rows, "go", F.col("version_range"))


def _toml_rows(name: str, text: str) -> list[tuple[str | None, str, str | None, str]]:
    """(group, artifact, spec, scope) of a TOML manifest; none if it can't be read."""
    try:
        read = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    spec = lambda v: v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None
    table = lambda t, scope: [(None, k, spec(v), scope) for k, v in (t or {}).items() if k != "python"]
    if name == "Cargo.toml":
        return [row for section, scope in CARGO_SECTIONS.items() for row in table(read.get(section), scope)]
    if name == "Pipfile":
        return table(read.get("packages"), "compile") + table(read.get("dev-packages"), "dev")
    project, poetry = read.get("project", {}), read.get("tool", {}).get("poetry", {})
    out = [(None, d, None, "compile") for d in project.get("dependencies", [])]
    out += [(None, d, None, "dev") for group in project.get("optional-dependencies", {}).values() for d in group]
    out += table(poetry.get("dependencies"), "compile") + table(poetry.get("dev-dependencies"), "dev")
    return out + [row for g in poetry.get("group", {}).values() for row in table(g.get("dependencies"), "dev")]


def toml(files: DataFrame) -> DataFrame:
    """pyproject.toml, Pipfile and Cargo.toml; TOML needs Python, manifests are few and small."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, *row, at) for path, text in zip(part["path"], part["content"]) for at, row in enumerate(_toml_rows(path.rsplit("/", 1)[-1], text or ""))]
            yield pd.DataFrame(rows, columns=["path", "group_name", "artifact_name", "version_range", "scope", "at"])

    found = _named(files, "pyproject.toml", "Pipfile", "Cargo.toml").select("path", "content").mapInPandas(read, _SCHEMA)
    split = found.withColumn("r", requirement(F.col("artifact_name")))
    named = split.withColumns({"artifact_name": F.coalesce(F.col("r.name"), F.col("artifact_name")), "version_range": F.coalesce("version_range", F.col("r.spec")), "ecosystem": ecosystem(F.col("path"))})
    version = F.when(F.col("ecosystem") == "pip", pinned(F.col("version_range"))).otherwise(F.col("version_range"))
    return named.withColumn("version", version).select(*_OUT)


#: Parsers of manifests: files (path, content) to rows (path, ecosystem, group_name, artifact_name, version, version_range, scope, at). Others may be added.
PARSERS = Registry()
for _n, (_name, _parse) in enumerate((("pom", pom), ("gradle", gradle), ("npm", npm), ("requirements", requirements), ("go", go_mod), ("toml", toml))):
    PARSERS.add(10 * _n, _name, _parse)


def dependencies(files: DataFrame, parsers: Registry = PARSERS) -> DataFrame:
    """Dependencies of all manifests among files (path, content), the first of each (ecosystem, group, artifact)."""
    every = None
    for _, parse, _ in parsers:
        every = parse(files) if every is None else every.unionByName(parse(files))
    first = Window.partitionBy("ecosystem", "group_name", "artifact_name").orderBy("path", "at")
    return every.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
