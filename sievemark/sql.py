"""The library's functions under names that SQL can call.

``register(spark)`` makes temporary functions of a session: column functions become SQL functions with the very expressions of the DataFrame
form, so Catalyst inlines them and nothing leaves the JVM; ``parse_prices`` is a SQL table function of the same kind;
``parse_html`` is a Python table function, as parsing HTML is what needs Python, with Arrow batches in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import money, text, urls
from .shipping import ship
from .sources import html

#: The column functions, of one string, by name.
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "normalize_text": text.normalized, "collapse_text": text.collapsed, "escape_html": text.escaped, "title_name": text.title_name, "emails_in": text.emails, "phones_in": text.phones,
    "normalize_url": urls.normalize, "url_host": urls.host, "page_kind": urls.page_kind, "is_relevant_url": urls.relevant, "is_excluded_url": urls.excluded, "is_home_page": urls.home_page,
    "is_public_url": urls.safe_public, "url_attribution": urls.attribution, "price_number": money.number, "price_key": money.price_key, "prices_in": money.prices,
}

_VARIABLE = "namedlambdavariable()"


def _nodes(node) -> Iterator:
    """An expression's nodes in the order in which its SQL shows them."""
    yield node
    try:
        shown = node.parameters()  # of an expression that stands for another
    except Py4JError:
        shown = node.children()
    for k in range(shown.size()):
        yield from _nodes(shown.apply(k))


def _skip(sql: str, at: int) -> int:
    """The place after a quoted string that begins at ``at``."""
    quote, at = sql[at], at + 1
    while sql[at] != quote:
        at += 2 if sql[at] == "\\" else 1
    return at + 1


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens before ``at``, and the place after it closes."""
    depth, start, parts = 1, at, []
    while depth:
        if sql[at] in "'`":
            at = _skip(sql, at)
            continue
        depth += (sql[at] == "(") - (sql[at] == ")")
        if depth == 1 and sql[at] == "," or not depth:
            parts.append(sql[start:at].strip())
            start = at + 1
        at += 1
    return parts, at


def _parsable(sql: str, variables: Iterator[str], structs: Iterator[list[str]]) -> str:
    """``sql`` with lambdas as arrows and structs with their names, which the SQL of an analysed expression leaves out."""
    out, at = [], 0
    while at < len(sql):
        if sql[at] in "'`":
            end = _skip(sql, at)
            out.append(sql[at:end])
            at = end
        elif sql.startswith("lambdafunction(", at):
            (body, *names), at = _arguments(sql, at + len("lambdafunction("))
            body = _parsable(body, variables, structs)
            names = [next(variables) for _ in names]
            out.append(f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}")
        elif sql.startswith("struct(", at) and not (at and (sql[at - 1].isalnum() or sql[at - 1] == "_")):
            fields = next(structs)
            values, at = _arguments(sql, at + len("struct("))
            out.append("named_struct(" + ", ".join(f"'{f}', {_parsable(v, variables, structs)}" for f, v in zip(fields, values, strict=True)) + ")")
        elif sql.startswith(_VARIABLE, at):
            out.append(next(variables))
            at += len(_VARIABLE)
        else:
            out.append(sql[at])
            at += 1
    return "".join(out)


def expression_sql(spark: SparkSession, fn: Callable[[Column], Column]) -> str:
    """SQL text of ``fn`` of a string column ``x``."""
    plan = spark.sql("SELECT CAST(NULL AS STRING) AS x").select(fn(F.col("x")).alias("y"))._jdf.queryExecution().analyzed()
    node = plan.expressions().head().child()
    variables, structs = [], []
    for n in _nodes(node):
        kind = n.getClass().getSimpleName()
        if kind == "NamedLambdaVariable":
            variables.append(f"v{n.exprId().id()}")
        elif kind == "CreateNamedStruct" and n.sql().startswith("struct("):
            structs.append([str(n.names().apply(k)) for k in range(n.names().size())])
    left = iter(variables), iter(structs)
    sql = _parsable(node.sql(), *left)
    if any(next(x, None) is not None for x in left):
        raise ValueError("the expression has more variables or structs than its SQL shows")
    return sql


class ParseHtml:
    """One row a page: what ``html.parse`` gives of its HTML."""

    def eval(self, url: str, page: str) -> Iterator[tuple]:
        row = html.parse_one(url, page)
        maps = lambda n: n | {"offer": dict(n["offer"]), "values": dict(n["values"])}
        yield tuple([maps(n) for n in row[c]] if c == "nodes" else row[c] for c in html.PARSED.names)


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session; returns their names."""
    ship(spark)
    for name, fn in COLUMNS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURN {expression_sql(spark, fn)}")
    price = "display STRING, minimum DOUBLE, maximum DOUBLE, currency STRING, qualifier STRING, frequency STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_prices(x STRING) RETURNS TABLE ({price}) RETURN SELECT p.display, p.minimum, p.maximum, p.currency, p.qualifier, p.frequency FROM (SELECT explode({expression_sql(spark, money.prices)}) AS p)")
    spark.udtf.register("parse_html", F.udtf(ParseHtml, returnType=html.PARSED_DDL, useArrow=True))
    return [*COLUMNS, "parse_prices", "parse_html"]
