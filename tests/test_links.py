"""Links meet one path each, however many lie below their target."""

import pytest

from lithic.plans import queries, views  # noqa: F401  register their queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pages all in one folder, all with links to it, to its first page, and beyond."""
    sf = str(tmp_path_factory.mktemp("pages"))
    html = '<a href="/en/"><a href="/en"><a href="/en/1000?x"><a href="/gone">'
    rows = spark.range(1000, 1300).selectExpr("id AS page_id", "concat('http://x.org/en/', id) AS url", f"'{html}' AS html")
    none = spark.createDataFrame([(1, None, html), (2, "http://x.org/fr", None), (2, "http://x.org/fr", '<a href="/fr">')], "page_id long, url string, html string")
    rows.union(none).coalesce(1).write.parquet(f"{sf}/pages.parquet")
    return sf


def test_no_join_makes_a_row_per_link_and_path(spark, folder):
    df = queries.QUERIES["import_edges"](spark, folder)
    got = {(r.page_id, r.target): (r.path, r.import_type) for r in df.collect()}
    want = {(i, t): p for i in (1, *range(1000, 1300)) for t, p in (("en", ("en/1299", "absolute")), ("en/1000", ("en/1000", "absolute")), ("gone", (None, "external")))}
    assert got == want | {(2, "fr"): ("fr", "absolute")} and df.count() == len(got)


def test_joined_rows_stay_as_many_as_links(spark, folder):
    def most(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return most(node.executedPlan())
        if "QueryStageExec" in node.getClass().getSimpleName():
            return most(node.plan())
        below = node.children()
        own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
        return max([own, *(most(below.apply(i)) for i in range(below.size()))])

    for name, n in (("import_edges", 904), ("import_stats", 904), ("linked_files", 904)):
        df = queries.QUERIES[name](spark, folder)
        df.collect()
        assert 0 < most(df._jdf.queryExecution().executedPlan()) <= n


def test_counts_and_lists_of_links(spark, folder):
    assert tuple(queries.QUERIES["import_stats"](spark, folder).first()) == (904, 603, 301)
    got = {r.path: (r.imports, r.importers) for r in queries.QUERIES["linked_files"](spark, folder).collect()}
    names = [f"en/{i}" for i in range(1000, 1300)]
    assert got["en/1299"] == ("en/1000", ",".join(names[:-1])) and got["en/1000"] == ("en/1299", ",".join(names[1:])) and got["en/1100"] == ("en/1000,en/1299", "") and got["fr"] == ("", "")
