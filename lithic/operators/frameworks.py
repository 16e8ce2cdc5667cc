"""Frameworks, tags, routes and middleware from nodes, annotations and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import first_match, naming, route_pattern
from lithic.operators.registry import Registry

#: Fixed values: (framework, category, file names, texts in them).
FILE_SIGNATURES = [
    ("spring_boot", "backend", ["pom.xml", "build.gradle", "build.gradle.kts"], ["spring-boot-starter", "org.springframework.boot"], r"<version>([\d.]+)</version>"),
    ("react", "frontend", ["package.json"], ['"react":', '"react-dom":'], r'"react"\s*:\s*"([^"]+)"'),
    ("vue", "frontend", ["package.json"], ['"vue":'], r'"vue"\s*:\s*"([^"]+)"'),
    ("angular", "frontend", ["package.json"], ['"@angular/core":', '"@angular/common":'], r'"@angular/core"\s*:\s*"([^"]+)"'),
    ("express", "backend", ["package.json"], ['"express":'], r'"express"\s*:\s*"([^"]+)"'),
    ("flask", "backend", ["requirements.txt", "Pipfile", "pyproject.toml", "setup.py"], ["flask", "Flask"], r"flask[>=~]=?\s*([\d.]+)"),
    ("fastapi", "backend", ["requirements.txt", "Pipfile", "pyproject.toml", "setup.py"], ["fastapi", "FastAPI"], r"fastapi[>=~]=?\s*([\d.]+)"),
    ("django", "backend", ["requirements.txt", "Pipfile", "pyproject.toml", "setup.py"], ["django", "Django"], r"django[>=~]=?\s*([\d.]+)"),
    ("gin", "backend", ["go.mod"], ["gin-gonic/gin"], r"github\.com/gin-gonic/gin\s+v([\d.]+)"),
    ("echo", "backend", ["go.mod"], ["labstack/echo"], r"github\.com/labstack/echo\s+v([\d.]+)"),
    ("nestjs", "backend", ["package.json"], ['"@nestjs/core":'], r'"@nestjs/core"\s*:\s*"([^"]+)"'),
]
#: Fixed values: (framework, file endings).
ENDING_SIGNATURES = [("vue", [".vue"]), ("react", [".tsx", ".jsx"]), ("angular", [".component.ts", ".module.ts"]), ("java", [".java"]), ("python", [".py"]), ("go", [".go"])]
#: Fixed values: (framework, tags, annotations).
NODE_SIGNATURES = [
    ("react", ["react-component", "react-hook", "react-context"], []),
    ("vue", ["vue-component", "vue-composable", "vue-lifecycle", "vue-component-api"], []),
    ("spring_boot", ["http-controller", "business-service", "data-repository", "spring-component", "spring-config", "spring-aspect"], ["@RestController", "@Controller", "@Service", "@Repository", "@Component", "@Configuration", "@Autowired", "@GetMapping", "@PostMapping", "@SpringBootApplication"]),
    ("flask", ["flask-route"], ["@app.route"]),
    ("fastapi", ["fastapi-route"], ["@app.get", "@app.post", "@router.get", "@router.post"]),
    ("celery", ["celery-task"], []),
    ("gin", ["http-handler"], []),
]
#: What an annotation tags a Java node as.
JAVA_TAGS = {
    "@RestController": "http-controller", "@Controller": "http-controller", "@Service": "business-service", "@Repository": "data-repository", "@Component": "spring-component",
    "@Configuration": "spring-config", "@Bean": "spring-bean", "@Autowired": "dependency-injection", "@Inject": "dependency-injection", "@RequestMapping": "api-endpoint",
    "@GetMapping": "api-endpoint", "@PostMapping": "api-endpoint", "@PutMapping": "api-endpoint", "@DeleteMapping": "api-endpoint", "@PatchMapping": "api-endpoint",
    "@Aspect": "spring-aspect", "@Transactional": "transactional", "@Scheduled": "scheduled-task", "@SpringBootApplication": "spring-boot-app",
}
#: What the beginning of a decorator tags a Python node as, in order.
PYTHON_TAGS = {
    "@app.route": "flask-route", "@bp.route": "flask-route", "@app.get": "fastapi-route", "@app.post": "fastapi-route", "@app.put": "fastapi-route", "@app.delete": "fastapi-route",
    "@router.get": "fastapi-route", "@router.post": "fastapi-route", "@router.put": "fastapi-route", "@router.delete": "fastapi-route", "@celery.task": "celery-task",
    "@shared_task": "celery-task", "@lru_cache": "cached-function", "@cache": "cached-function", "@staticmethod": "static-method", "@classmethod": "static-method",
    "@property": "property", "@contextmanager": "context-manager",
}
#: HTTP methods of annotations; an empty one is read from the arguments.
SPRING_METHODS = {"@GetMapping": "GET", "@PostMapping": "POST", "@PutMapping": "PUT", "@DeleteMapping": "DELETE", "@PatchMapping": "PATCH", "@RequestMapping": ""}
PYTHON_METHODS = {
    "@app.route": "GET", "@app.get": "GET", "@app.post": "POST", "@app.put": "PUT", "@app.delete": "DELETE", "@app.patch": "PATCH",
    "@bp.route": "GET", "@bp.get": "GET", "@bp.post": "POST", "@bp.put": "PUT", "@bp.delete": "DELETE", "@bp.patch": "PATCH",
    "@router.get": "GET", "@router.post": "POST", "@router.put": "PUT", "@router.delete": "DELETE", "@router.patch": "PATCH",
}
#: Kinds of middleware by what their names contain, in order.
MIDDLEWARE_KINDS = {
    "auth": "authentication", "login": "authentication", "token": "authentication", "jwt": "authentication", "session": "authentication", "rate": "rate_limiting",
    "limit": "rate_limiting", "throttle": "rate_limiting", "log": "logging", "logger": "logging", "cors": "cors", "csrf": "security", "security": "security",
    "helmet": "security", "compress": "compression", "gzip": "compression", "body": "body_parser", "json": "body_parser", "urlencoded": "body_parser",
    "static": "static_files", "cookie": "cookie",
}
TEXT_STEP, TEXT_CAP, ENDING_STEP, ENDING_CAP, NODE_STEP, NODE_CAP = 0.1, 0.3, 0.05, 0.2, 0.1, 0.4


def _rules(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rules with their order; small enough to broadcast."""
    return F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"rule int, {schema}"))


def by_manifest(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(framework, confidence, version) from manifests: 0.1 for each text found, at most 0.3 over all files."""
    rules = _rules(files.sparkSession, FILE_SIGNATURES, "framework string, category string, names array<string>, texts array<string>, version_pattern string")
    named = files.withColumn("__name", F.substring_index(path, "/", -1)).join(rules, F.array_contains("names", F.col("__name")))
    hits = F.size(F.filter("texts", lambda t: F.col(content).contains(t)))
    version = F.expr(f"nullif(regexp_extract({content}, version_pattern, 1), '')")
    per_file = named.select("framework", hits.alias("hits"), version.alias("version")).where("hits > 0")
    return per_file.groupBy("framework").agg(F.least(F.sum(F.col("hits") * TEXT_STEP), F.lit(TEXT_CAP)).alias("confidence"), F.max("version").alias("version"))


def by_ending(files: DataFrame, path: str = "path") -> DataFrame:
    """(framework, confidence) from file endings: 0.05 a file, at most 0.2."""
    rules = _rules(files.sparkSession, [(f, e) for f, ends in ENDING_SIGNATURES for e in ends], "framework string, ending string")
    found = files.select(path).distinct().join(rules, F.col(path).endswith(F.col("ending")))
    return found.groupBy("framework").agg(F.least(F.countDistinct(path) * ENDING_STEP, F.lit(ENDING_CAP)).alias("confidence"))


def by_nodes(nodes: DataFrame) -> DataFrame:
    """(framework, confidence) from nodes' tags (equal) and annotations (beginning, first framework): each 0.1 a hit, at most 0.4."""
    spark = nodes.sparkSession
    tags = _rules(spark, [(f, t) for f, ts, _ in NODE_SIGNATURES for t in ts], "framework string, tag string")
    prefixes = _rules(spark, [(f, a) for f, _, names in NODE_SIGNATURES for a in names], "framework string, prefix string")
    from_tags = nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).join(tags, "tag").select("framework", "n")
    names = nodes.select(F.explode("annotations").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    first = names.join(prefixes, F.col("a").startswith(F.col("prefix"))).groupBy("a").agg(F.min_by("framework", "rule").alias("framework"), F.max("n").alias("n"))
    score = lambda df: df.groupBy("framework").agg(F.least(F.sum("n") * NODE_STEP, F.lit(NODE_CAP)).alias("confidence"))
    both = score(from_tags).union(score(first.select("framework", "n")))
    return both.groupBy("framework").agg(F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"))


#: Taggers: expressions of a node's columns that give an array of tags, for nodes of the languages they are registered with. Others may be added.
TAGGERS = Registry()


@TAGGERS.register(10, "java", languages=("java",))
def _java_tags() -> Column:
    java = F.create_map(*(F.lit(x) for kv in JAVA_TAGS.items() for x in kv))
    return F.array_compact(F.transform("annotations", lambda a: F.try_element_at(java, a)))


@TAGGERS.register(20, "python", languages=("python",))
def _python_tags() -> Column:
    first = lambda a: F.coalesce(*(F.when(a.startswith(k), v) for k, v in PYTHON_TAGS.items()))
    return F.array_compact(F.transform("annotations", first))


@TAGGERS.register(30, "script", languages=("typescript", "javascript"))
def _script_tags() -> Column:
    kind = naming(F.col("name"))
    return F.array_compact(F.array(F.when(kind == "hook", "react-hook"), F.when((kind == "component") & F.col("node_type").isin("function", "class"), "react-component"), F.when(F.col("name").endswith("Context"), "react-context")))


@TAGGERS.register(40, "go", languages=("go",))
def _go_tags() -> Column:
    return F.array_compact(F.array(F.when(F.coalesce("signature", F.lit("")).rlike(r"\*gin\.Context|echo\.Context|http\.ResponseWriter"), "http-handler")))


@TAGGERS.register(50, "vue", languages=("vue",))
def _vue_tags() -> Column:
    return F.array_compact(F.array(F.when(F.col("name").rlike("^use[A-Z]"), "vue-composable"), F.when(F.col("name").isin("mounted", "created", "updated", "onMounted", "onUpdated", "onUnmounted"), "vue-lifecycle")))


def tagged(nodes: DataFrame, taggers: Registry = TAGGERS) -> DataFrame:
    """Nodes (language, node_type, name, annotations, tags, signature) with the tags of their language's taggers, in order, put behind their own, none twice."""
    none = F.array().cast("array<string>")
    tags = F.coalesce("tags", none)
    for _, build, more in taggers:
        tags = F.array_union(tags, F.coalesce(F.when(F.col("language").isin(*more["languages"]), build()), none))
    return nodes.withColumn("tags", tags)


def _unquoted(arg: Column) -> Column:
    return F.regexp_replace(F.trim(arg), "^[\"']|[\"']$", "")


def _method(args: Column) -> Column:
    named = F.transform(args, lambda a: F.regexp_extract(F.upper(a), r"METHODS?\s*=.*?\b(GET|POST|PUT|DELETE|PATCH)\b", 1))
    return F.coalesce(F.try_element_at(F.filter(named, lambda m: m != ""), F.lit(1)), F.lit("GET"))


def annotated_routes(nodes: DataFrame) -> DataFrame:
    """(http_method, path_pattern, handler, file_path, framework) from annotations struct(name, args) of functions and methods."""
    spark = nodes.sparkSession
    rows = [("spring", k, v, True) for k, v in SPRING_METHODS.items()] + [("python", k, v, False) for k, v in PYTHON_METHODS.items()]
    rules = _rules(spark, rows, "framework string, prefix string, http string, whole boolean")
    each = nodes.where(F.col("node_type").isin("function", "method")).select("id", F.col("name").alias("handler"), "file_path", F.posexplode("annotations").alias("at", "a"))
    hit = F.when(F.col("whole"), F.col("a.name") == F.col("prefix")).otherwise(F.col("a.name").startswith(F.col("prefix")))
    found = each.join(rules, hit)
    best = Window.partitionBy("id", "at", "framework").orderBy("rule")
    first = found.withColumn("__rank", F.row_number().over(best)).where("__rank = 1")
    cleaned = F.transform("a.args", lambda x: _unquoted(F.regexp_replace(x, r"^\s*(value|path)\s*=\s*", "")))
    path = F.coalesce(F.try_element_at(F.filter(cleaned, lambda x: x.startswith("/")), F.lit(1)), F.lit("/"))
    asks = (F.col("http") == "") | F.col("prefix").endswith(".route")
    return first.select(F.when(asks, _method(F.col("a.args"))).otherwise(F.col("http")).alias("http_method"), route_pattern(path).alias("path_pattern"), "handler", "file_path", "framework")


def express_routes(calls: DataFrame) -> DataFrame:
    """Routes from calls `app.get('/path', ...)` in JavaScript and TypeScript: (http_method, path_pattern, handler, file_path, framework)."""
    text = F.coalesce("qualified_name", "name")
    parts = lambda g: F.regexp_extract(text, r"\.(get|post|put|delete|patch|use|all)\s*\(\s*['\"](/[^'\"]*)['\"]", g)
    found = calls.where(F.col("language").isin("javascript", "typescript")).withColumns({"__m": parts(1), "__p": parts(2)}).where("__p <> ''")
    return found.select(F.upper("__m").alias("http_method"), route_pattern(F.col("__p")).alias("path_pattern"), F.col("name").alias("handler"), "file_path", F.lit("express").alias("framework"))


def configured_routes(files: DataFrame, content: str = "content") -> DataFrame:
    """Routes of front-end configurations: each `path: '...'` with the component named before the next one, once per file."""
    parts = F.slice(F.split(F.col(content), r"(?=\bpath\s*:\s*['\"`])"), 2, 1_000_000)
    each = files.select(F.col("path").alias("file_path"), F.posexplode(parts).alias("at", "part"))
    window = F.substring("part", 1, 500)
    component = F.regexp_extract(window, r"(?:component|element)\s*:\s*(?:\(\)\s*=>\s*import\(\s*)?['\"<]?([\w@./-]+)", 1)
    routes = each.select("file_path", "at", F.regexp_extract("part", r"^path\s*:\s*['\"`]([^'\"`]*)", 1).alias("__p"), component.alias("handler"))
    once = routes.withColumn("__rank", F.row_number().over(Window.partitionBy("file_path", "__p").orderBy("at"))).where("__rank = 1")
    return once.select(F.lit("GET").alias("http_method"), route_pattern(F.col("__p")).alias("path_pattern"), "handler", "file_path", F.lit("frontend").alias("framework"))


#: Ways to find routes, each from (nodes, calls, files). Others may be added.
ROUTES = Registry()
ROUTES.add(10, "annotations", lambda nodes, calls, files: annotated_routes(nodes))
ROUTES.add(20, "express", lambda nodes, calls, files: express_routes(calls))
ROUTES.add(30, "configurations", lambda nodes, calls, files: configured_routes(files))


def routes(nodes: DataFrame, calls: DataFrame, files: DataFrame, ways: Registry = ROUTES) -> DataFrame:
    return reduce(DataFrame.unionByName, [find(nodes, calls, files) for _, find, _ in ways])


def middleware(calls: DataFrame, kinds: dict[str, str] = MIDDLEWARE_KINDS) -> DataFrame:
    """(name, kind, file_path, start_line) of `*.use` calls and interceptor registrations, in source order; kinds by what a name contains."""
    used = calls.where((F.col("name") == "*.use") | (F.col("name") == "addInterceptors"))
    what = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("qualified_name", "name"), r"use\(\s*([\w.]+)", 1), F.lit("")), F.col("name"))
    return used.select(what.alias("name"), first_match(what, kinds, "generic").alias("kind"), "file_path", "start_line").orderBy("file_path", "start_line", "name")
