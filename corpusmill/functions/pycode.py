"""Python source to skeletons and symbols.

Parsing Python needs Python: these are the library's only text functions that
leave the JVM.  They run as Arrow-batched pandas UDFs, one row at a time, and
never fail a task on bad source.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

SYMBOL_TYPE = "array<struct<ord:int,kind:string,parent:string,name:string>>"


def skeleton_source(source: str) -> str:
    """Signatures, decorators and docstrings of a module, bodies left out.

    A class whose body holds only assignments comes out without a body, which
    is not valid Python; readers of the outline do not mind.
    """
    try:
        module = ast.parse(source)
        module.body = _outline(module.body, keep=_FUNCTIONS + (ast.ClassDef,))
        return ast.unparse(ast.fix_missing_locations(module))
    except SyntaxError as problem:
        return f"# [SKIPPING SKELETON] File has syntax errors: {problem}\n"
    except Exception as problem:
        return f"# [ERROR] AST skeletonization failed: {problem}\n"


def _outline(body: list[ast.stmt], keep: tuple) -> list[ast.stmt]:
    kept = [node for node in body if isinstance(node, keep)]
    for node in kept:
        if isinstance(node, ast.ClassDef):
            node.body = _outline(node.body, keep=_FUNCTIONS + (ast.ClassDef, ast.Expr))
        elif isinstance(node, _FUNCTIONS):
            text = ast.get_docstring(node)
            node.body = [ast.Expr(ast.Constant(text))] if text else []
            node.body.append(ast.Pass())
    return kept


def list_symbols(source: str, functions: bool, classes: bool, methods: bool) -> list[dict]:
    """Top-level functions and classes, and the methods of shown classes.

    ``async def`` is not listed.  Unparsable source gives one error symbol.
    """
    try:
        body = ast.parse(source).body
    except SyntaxError as problem:
        return [_error(f"Invalid AST (SyntaxError): {problem.msg} (line {problem.lineno})")]
    except Exception as problem:
        return [_error(f"AST Parsing failed: {problem}")]
    found: list[tuple[str, str | None, str]] = []
    for node in body:
        if functions and isinstance(node, ast.FunctionDef):
            found.append(("function", None, node.name))
        elif classes and isinstance(node, ast.ClassDef):
            found.append(("class", None, node.name))
            if methods:
                found.extend(
                    ("method", node.name, child.name)
                    for child in node.body
                    if isinstance(child, ast.FunctionDef)
                )
    return [
        {"ord": i, "kind": kind, "parent": parent, "name": name}
        for i, (kind, parent, name) in enumerate(found)
    ]


def _error(message: str) -> dict:
    return {"ord": 0, "kind": "error", "parent": None, "name": message}


def skeleton(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(skeleton_source, na_action="ignore")

    return run(source)


def is_python(ext: Column) -> Column:
    return F.lower(ext) == ".py"


def skeleton_where_python(source: Column, ext: Column) -> Column:
    """Skeleton of ``.py`` text; other text passes by without leaving the JVM."""
    # Python workers evaluate UDF arguments for every row, so other rows send
    # a null instead of their text.
    outline = skeleton(F.when(is_python(ext), source))
    return F.when(is_python(ext), outline).otherwise(source)


def symbols(
    source: Column, functions: bool = True, classes: bool = True, methods: bool = True
) -> Column:
    @F.pandas_udf(SYMBOL_TYPE)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(
            lambda text: [] if text is None else list_symbols(text, functions, classes, methods)
        )

    return run(source)


def symbol_label(kind: Column, name: Column) -> Column:
    """The line a symbol gets in a rendered tree."""
    return (
        F.when(kind == "function", F.concat(F.lit("Function: "), name, F.lit("()")))
        .when(kind == "class", F.concat(F.lit("Class: "), name))
        .when(kind == "method", F.concat(F.lit("  Method: "), name, F.lit("()")))
        .otherwise(F.concat(F.lit("[ERROR] "), name))
    )
