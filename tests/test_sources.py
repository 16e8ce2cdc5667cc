import json

from pyspark.sql import functions as F

from lithic.sources import manifests, parsers, scan

FILES = {
    "pom.xml": "<project><!-- <dependency><artifactId>no</artifactId></dependency> --><dependencies><dependency><groupId>org.x</groupId><artifactId>a</artifactId><version>1.0</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><scope>test</scope></dependency></dependencies></project>",
    "app/build.gradle": "dependencies {\n implementation 'g1:a1:1.2'\n testImplementation \"g2:a2\"\n compileOnly 'g3:a3:3'\n}",
    "package.json": json.dumps({"dependencies": {"react": "^18.0", "@a/b": "1.0.0"}, "devDependencies": {"jest": "29.0.0"}}),
    "requirements.txt": "flask==2.0 # web\nrequests>=2\n# only a comment\nextra[all]==1\n-r other.txt\n",
    "pyproject.toml": '[project]\ndependencies = ["numpy==1.26", "pandas>=2; python_version>\'3\'"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrich = "13"\n[tool.poetry.dev-dependencies]\npytest = {version = "8"}\n',
    "go.mod": "module m\nrequire github.com/a/b v1.0.0\nrequire github.com/c/d v1.1.0 // indirect\nrequire (\n\tgithub.com/e/f v2.0.0\n\tgithub.com/g/h v3.0.0 // indirect\n)\n",
    "Cargo.toml": '[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = {version = "0.8"}\n',
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_manifests(spark):
    rows = {(r.ecosystem, r.group_name, r.artifact_name): (r.version, r.version_range, r.scope) for r in manifests.dependencies(frame(spark, FILES)).collect()}
    assert rows[("maven", "org.x", "a")] == ("1.0", "1.0", "compile") and rows[("maven", "g", "b")][2] == "test" and ("maven", None, "no") not in rows
    assert rows[("maven", "g1", "a1")] == ("1.2", "1.2", "compile") and rows[("maven", "g2", "a2")] == (None, None, "test") and rows[("maven", "g3", "a3")][2] == "runtime"
    assert rows[("npm", None, "react")] == (None, "^18.0", "compile") and rows[("npm", "@a", "b")] == ("1.0.0", "1.0.0", "compile") and rows[("npm", None, "jest")][2] == "dev"
    assert rows[("pip", None, "flask")][0] == "2.0" and rows[("pip", None, "requests")] == (None, ">=2", "compile") and ("pip", None, "extra") not in rows
    assert rows[("pip", None, "numpy")][0] == "1.26" and rows[("pip", None, "pandas")][0] is None and ("pip", None, "python") not in rows and rows[("pip", None, "pytest")][2] == "dev"
    assert {k[2] for k in rows if k[0] == "go"} == {"github.com/a/b", "github.com/e/f", "github.com/g/h"}
    assert rows[("cargo", None, "serde")][2] == "compile" and rows[("cargo", None, "rand")] == ("0.8", "0.8", "dev")


def test_languages_and_selection(spark):
    paths = {"a.py": "python", "b/x.test.ts": "typescript", "c.js.map": "javascript", "d.H": "c", "README.md": "markdown", "Makefile": "unknown", ".py": "unknown"}
    got = {r.path: r.l for r in frame(spark, dict.fromkeys(paths, "")).select("path", scan.language(F.col("path")).alias("l")).collect()}
    assert got == paths
    picked = frame(spark, dict.fromkeys(["src/a.py", "node_modules/b.js", "x/build/c.py", "package.json", "data.json", "build.py"], ""))
    assert {r.path for r in picked.where(scan.is_wanted(F.col("path"))).collect()} == {"src/a.py", "package.json", "build.py"}


def test_repository_scan(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\ny = 2\n", "src/b.py": "", "dist/c.py": "z", "big.py": "\n" * 10_001, "go.mod": "module m"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.path: (r.line_count, r.language) for r in scan.repository(spark, str(tmp_path)).collect()}
    assert rows == {"src/a.py": (2, "python"), "go.mod": (1, "unknown")}


def test_data_sets_and_history(spark, tmp_path):
    data = {"repo_id": "r", "language": "python", "category": "DP", "test_cases": [{"id": "1", "language": None, "category": "AL", "expected_points": [{"title": "t", "confidence": 0.5}]}, {"id": "2", "expected_points": []}]}
    (tmp_path / "d.json").write_text(json.dumps(data))
    cases = scan.datasets(spark, str(tmp_path / "d.json"))
    assert {(r.id, r.language, r.category) for r in cases.collect()} == {("1", "python", "AL"), ("2", "python", "DP")}
    assert [r.title for r in scan.expected_points(cases).collect()] == ["t"]
    (tmp_path / "h.jsonl").write_text('{"run": 1}\nnot json\n{"run": 2}\n')
    assert sorted(r.run for r in scan.history(spark, str(tmp_path / "h.jsonl"), "run int").collect()) == [1, 2]


PYTHON = '''import os, a.b as c
from ..x import y

@app.route("/p", methods=["POST"])
def top(a: int) -> str:
    """Doc."""
    return helper(a).run()

class C(Protocol):
    @property
    def m(self):
        def inner(): pass
        return inner()
'''


def test_python_parser(spark):
    files = spark.createDataFrame([("p/m.py", "python", PYTHON), ("bad.py", "python", "def ("), ("n.py", "python", None)], "path string, language string, content string")
    rows = parsers.nodes(files).collect()
    own = [r for r in rows if r.file_path == "p/m.py"]
    kinds = {(r.node_type, r.name) for r in own}
    assert {("import", "os"), ("import", "a.b"), ("import", "..x"), ("function", "top"), ("protocol", "C"), ("method", "m"), ("function", "inner"), ("call", "helper"), ("call", "*.run"), ("call", "inner")} <= kinds
    top = next(r for r in own if r.name == "top")
    assert top.qualified_name == "p.m.top" and top.docstring == "Doc." and top.signature == "def top(a: int) -> str"
    assert [(a.name, a.args) for a in top.annotations] == [("@app.route", ["'/p'", "methods=['POST']"])]
    assert next(r for r in own if r.name == "helper").parent_id == top.id and len({r.id for r in own}) == len(own)
    assert {r.file_path: r.error for r in rows if r.error} == {"bad.py": "SyntaxError", "n.py": "empty"}


def test_pattern_parsers(spark):
    files = [
        ("s/a.ts", "typescript", "import { x } from './x';\n// class No {}\ninterface I { a: number }\nexport class Svc {\n  run(a: string): void {\n    this.repo.save(a);\n  }\n}\nconst f = (a) => {\n  g(a);\n};\n"),
        ("A.java", "java", "package com.e;\nimport java.util.List;\n@RestController\npublic class A {\n  @GetMapping(\"/x\")\n  public String get(int a) {\n    return svc.find(new B(a));\n  }\n}\n"),
        ("m.go", "go", 'package m\nimport "fmt"\ntype S struct {\n a int\n}\nfunc (s *S) Do(a int) {\n fmt.Println(a)\n}\nfunc Top() {\n}\n'),
        ("V.vue", "vue", "<template/>\n<script>\nexport function useX() {\n  load();\n}\n</script>\n"),
        ("o.js", "javascript", "const o = require('lib');\nmodule.exports = {\n  act: function () {\n    run();\n  },\n};\n"),
    ]
    rows = parsers.nodes(spark.createDataFrame(files, "path string, language string, content string")).collect()
    kinds = {(r.file_path, r.node_type, r.name) for r in rows}
    assert {("s/a.ts", "import", "./x"), ("s/a.ts", "interface", "I"), ("s/a.ts", "class", "Svc"), ("s/a.ts", "method", "run"), ("s/a.ts", "function", "f"), ("s/a.ts", "call", "*.save"), ("s/a.ts", "call", "g")} <= kinds
    assert not any(r.name == "No" for r in rows)
    assert {("A.java", "import", "java.util.List"), ("A.java", "class", "A"), ("A.java", "method", "get"), ("A.java", "call", "*.find"), ("A.java", "call", "new B")} <= kinds
    by = {(r.file_path, r.node_type, r.name): r for r in rows}
    assert by["A.java", "method", "get"].qualified_name == "com.e.A.get" and by["A.java", "method", "get"].annotations[0].name == "@GetMapping"
    assert by["m.go", "method", "Do"].qualified_name == "m:S.Do" and ("m.go", "struct", "S") in kinds and ("m.go", "import", "fmt") in kinds
    assert by["s/a.ts", "method", "run"].qualified_name == "s/a:Svc.run" and by["s/a.ts", "call", "*.save"].parent_id == by["s/a.ts", "method", "run"].id
    assert ("V.vue", "function", "useX") in kinds and by["V.vue", "call", "load"].start_line == 4 and ("o.js", "object_method", "act") in kinds and ("o.js", "import", "lib") in kinds
