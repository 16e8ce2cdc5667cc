"""Reading repositories, data sets and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.text import line_count

#: Languages by file ending.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".vue": "vue",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".md": "markdown", ".txt": "text", ".rst": "rst",
}
NON_SOURCE = ("json", "yaml", "toml", "ini", "markdown", "text", "rst")
#: Languages that are parsed.
PARSED = ("python", "typescript", "javascript", "java", "go", "vue")
#: Folders that are not scanned.
EXCLUDED = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "dist", "build", "target", "out", "bin", "obj",
    ".idea", ".vscode", ".next", "coverage", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".vs",
)
#: Manifests, scanned though they are no source files.
MANIFESTS = ("package.json", "pom.xml", "build.gradle", "build.gradle.kts", "requirements.txt", "pyproject.toml", "Pipfile", "go.mod", "Cargo.toml")
MAX_BYTES, MAX_LINES, MAX_FILES = 10 * 1024 * 1024, 10_000, 50_000
DATASET = (
    "repo_id string, language string, category string, description string, prompt_version string, test_cases array<struct<"
    "id: string, description: string, language: string, category: string, difficulty: string, tags: array<string>, "
    "code_snippets: array<struct<file: string, language: string, start_line: int, end_line: int, content: string, highlighted_lines: array<int>, is_synthetic: boolean>>, "
    "expected_points: array<struct<category: string, prefix: string, title: string, description: string, confidence: double, alternative_titles: array<string>, code_lines_match: array<int>>>>>"
)


def language(path: Column) -> Column:
    """Language by the file's ending, or by the ending before it (`x.js.map`); unknown otherwise."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    name = F.substring_index(path, "/", -1)
    last = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    before = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)\.[^.]+$", 1))
    return F.coalesce(F.try_element_at(known, last), F.try_element_at(known, before), F.lit("unknown"))


def is_source(lang: Column) -> Column:
    return (lang != "unknown") & ~lang.isin(*NON_SOURCE)


def is_wanted(path: Column) -> Column:
    """Source files and manifests outside of excluded folders. path is relative to the scanned root."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in EXCLUDED))) & (is_source(language(path)) | F.substring_index(path, "/", -1).isin(*MANIFESTS))


def profiled(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with hash, size, line count and language; those over the size or line limit are left out."""
    out = files.withColumns({"size_bytes": F.octet_length(content), "content_hash": F.sha2(F.col(content), 256), "line_count": line_count(F.col(content)), "language": language(F.col("path"))})
    return out.where((F.col("size_bytes") <= MAX_BYTES) & (F.col("line_count") <= MAX_LINES))


def repository(spark: SparkSession, root: str, most: int = MAX_FILES) -> DataFrame:
    """(path, content, size_bytes, content_hash, line_count, language) of a repository's files, the first `most` by path.

    Names and sizes are filtered before contents are read. Spark does not list files without content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean_root = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + clean_root.replace(".", r"\."), "")
    wanted = raw.where(F.col("length") <= MAX_BYTES).select(relative.alias("path"), "content").where(is_wanted(F.col("path")))
    profiles = profiled(wanted.select("path", F.decode("content", "UTF-8").alias("content")))
    # the order is found among paths alone; contents are only read for those that stay
    first = profiles.select("path").orderBy("path").limit(most)
    return profiles.join(first, "path", "left_semi")


def resumed(spark: SparkSession, table: str, version: str) -> DataFrame:
    """Files of an analysis version as stored."""
    return spark.read.parquet(table).where(F.col("analysis_version") == version)


def of_repository(spark: SparkSession, table: str, repository_id: str, order: str) -> DataFrame:
    """Rows of one repository; a table partitioned by repository_id is read in that part only."""
    return spark.read.parquet(table).where(F.col("repository_id") == repository_id).orderBy(order)


def by_hash(files: DataFrame, digest: str) -> DataFrame:
    """All files with this content."""
    return files.where(F.col("content_hash") == digest)


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """One row per test case of nested JSON data sets; a case without language or category has its data set's."""
    read = spark.read.schema(DATASET).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    cases = read.select("repo_id", "prompt_version", F.col("language").alias("__l"), F.col("category").alias("__c"), F.explode("test_cases").alias("case"))
    return cases.select("repo_id", "prompt_version", "case.*", "__l", "__c").withColumns({"language": F.coalesce("language", "__l"), "category": F.coalesce("category", "__c")}).drop("__l", "__c")


def expected_points(cases: DataFrame) -> DataFrame:
    return cases.select("repo_id", F.col("id").alias("case_id"), "language", F.posexplode("expected_points").alias("at", "point")).select("repo_id", "case_id", "language", "at", "point.*")


def manifests_above(spark: SparkSession, start: str, levels: int = 5) -> list[str]:
    """Paths of the manifests in `start` or, if it has none, in the nearest of the folders above, `levels` folders in all."""
    paths = spark._jvm.org.apache.hadoop.fs
    files = paths.Path(start).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = files.makeQualified(paths.Path(start))
    for _ in range(levels):
        if folder is None or not files.exists(folder):
            break
        tried = [paths.Path(folder, name) for name in MANIFESTS]
        if found := [p.toString() for p in tried if files.exists(p) and files.getFileStatus(p).isFile()]:
            return found
        folder = folder.getParent()
    return []


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """(name, hash) of prompt files; a version is the hash of all of them in order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("hash"))


def prompt_version(found: DataFrame, base: str) -> DataFrame:
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "hash"))), "\n")
    return found.agg(F.concat(F.lit(f"v{base}-"), F.substring(F.sha2(joined, 256), 1, 8)).alias("version"))


def snippets(files: DataFrame, most: int = 5000) -> DataFrame:
    return files.select("path", F.substring("content", 1, most).alias("content"))
