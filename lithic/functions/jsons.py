"""Reading JSON that models wrote: unwrap, repair, normalise."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category codes, and codes that stand for them.
CATEGORIES = ("DP", "AD", "AL", "ET", "DK", "TT", "TK")
CATEGORY_ALIASES = {"DS": "AL", "SE": "ET", "UI": "AD", "DB": "DK", "NET": "ET", "SEC": "ET", "PERF": "ET", "OOP": "DP", "ARCH": "AD", "TEST": "TT", "TOOL": "TK", "CONFIG": "ET"}
#: Known types of resources.
RESOURCES = ("book", "article", "video", "course")
#: How the title of a whole answer goes on after its category.
RAW_TITLE = " analysis"
POINT = "struct<category:string,prefix:string,title:string,description:string,confidence:double>"


def unfenced(text: Column) -> Column:
    """A text without a Markdown code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")


def points(text: Column) -> Column:
    """Array of points in a list, under `knowledge_points` or `items`, or a single one; null if the JSON can't be read."""
    body = unfenced(text)
    listed = F.from_json(body, f"array<{POINT}>")
    keyed = F.from_json(body, f"struct<knowledge_points:array<{POINT}>,items:array<{POINT}>>")
    single = F.from_json(body, POINT)
    return (
        F.when(body.startswith("["), listed)
        .when(keyed["knowledge_points"].isNotNull(), keyed["knowledge_points"])
        .when(keyed["items"].isNotNull(), keyed["items"])
        .when(single["title"].isNotNull(), F.array(single))
    )


def category_code(name: Column) -> Column:
    """A category's code, aliases resolved; null if unknown."""
    aliases = F.create_map(*(F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv))
    return F.when(name.isin(*CATEGORIES), name).otherwise(F.try_element_at(aliases, name))


def normalised_point(point: Column) -> Column:
    """A point with its category resolved and its prefix beginning with the category; null if title or confidence is invalid."""
    code = category_code(point["category"])
    prefix = F.when(point["prefix"].startswith(F.concat(code, F.lit("-"))), point["prefix"]).otherwise(F.concat(code, F.lit("-"), point["prefix"]))
    valid = code.isNotNull() & (F.length(F.trim(point["title"])) > 0) & point["confidence"].between(0, 1)
    return F.when(valid, F.struct(code.alias("category"), prefix.alias("prefix"), point["title"].alias("title"), point["description"].alias("description"), point["confidence"].alias("confidence")))


def salvaged(found: Column, category: Column, text: Column) -> Column:
    """The valid ones of an array of points, each made normal; without any, the whole text as one point of `category`."""
    valid = F.filter(F.transform(found, normalised_point), lambda p: p.isNotNull())
    whole = F.struct(
        category.alias("category"), F.concat(category, F.lit("-Unknown")).alias("prefix"), F.concat(category, F.lit(RAW_TITLE)).alias("title"),
        text.alias("description"), F.lit(0.8).alias("confidence"),
    )
    return F.when(F.size(valid) > 0, valid).otherwise(F.array(whole))


def file_path(snippet: Column) -> Column:
    """Path of a snippet (file_path, file): `file` where there is no `file_path`."""
    return F.coalesce(snippet["file_path"], snippet["file"], F.lit(""))


def signature(node: Column) -> Column:
    """Signature of a node of a call chain (signature, name): `name` where there is none."""
    return F.coalesce(node["signature"], node["name"], F.lit(""))


def line_pair(lines: Column) -> Column:
    """First and last line of an array: its first two items, the one it has twice, or zeros for an empty or null one."""
    n = F.coalesce(F.size(lines), F.lit(0))
    first = F.when(n > 0, F.get(lines, F.lit(0))).otherwise(F.lit(0))
    return F.array(first, F.when(n > 1, F.get(lines, F.lit(1))).otherwise(first))


def resource_type(name: Column) -> Column:
    """A resource's type in lower case; article if it is none of RESOURCES."""
    return F.when(F.lower(name).isin(*RESOURCES), F.lower(name)).otherwise(F.lit("article"))


def chain_node(text: Column) -> Column:
    """A call chain's item that is only a name, as a node."""
    return F.struct(
        F.lit("").alias("node_id"), F.lit("function_call").alias("node_type"), F.lit("").alias("file"), text.alias("name"),
        F.array().cast("array<int>").alias("lines"),
    )


def balanced(text: str) -> str | None:
    """The first balanced object or array in a text, brackets in strings not counted."""
    start = next((i for i, c in enumerate(text) if c in "[{"), None)
    if start is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


_AFTER_STRING = re.compile(r"\s*([,:\]}]|$)")


def _inner_quotes(text: str) -> str:
    """Escape quotes inside strings: those not followed by a comma, colon, bracket or the end."""
    out, quoted = [], False
    for i, c in enumerate(text):
        if c == '"' and text[i - 1 : i] != "\\":
            if not quoted:
                quoted = True
            elif _AFTER_STRING.match(text, i + 1):
                quoted = False
            else:
                out.append("\\")
        out.append(c)
    return "".join(out)


def repaired(text: str | None) -> str | None:
    """JSON text after the least repair that makes it readable: extraction, missing and trailing commas, inner quotes."""
    if text is None:
        return None
    found = balanced(re.sub(r"^```\w*\s*|\s*```$", "", text.strip())) or text
    steps = [lambda t: t, lambda t: re.sub(r",\s*([\]}])", r"\1", t), lambda t: re.sub(r'([}\]"\d])(\s*\n\s*|\s+(?=\{))(?=["{\[])', r"\1,\2", t), _inner_quotes]
    tried = found
    for step in steps:
        tried = step(tried)
        try:
            return json.dumps(json.loads(tried), ensure_ascii=False)
        except ValueError:
            continue
    return None


def with_repaired(rows: DataFrame, column: str, out: str) -> DataFrame:
    """`rows` with `out`: the JSON of `column`, repaired if need be, or null."""

    @F.pandas_udf("string")
    def repair(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(repaired)

    return rows.withColumn(out, repair(column))
