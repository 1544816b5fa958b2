"""Facts read few tokens, and no statement is put together twice: what is left unread declares, asks and imports nothing."""

import re

from pyspark.sql import functions as F

from edgewright.operators import extract, tokens
from edgewright.sources import files

PY = """import os, sys as system
from .near import (a, b as c,)
from . import *
x: int = 1
x.y = 2
class A(B):
    kind = "k"
    async def run(self):
        local = [1, 2, f(3)]
        return local
def top(): pass
"""
TS = """import D, { e as f, type G } from './x';
import * as ns from 'y';
import 'side';
export * from './all';
export { h as i } from 'k';
export const from = 'no', more = 2;
abstract class P { m(q) { const inside = { url: '/no' }; return inside } get z() { return 1 } }
const enum E { one }
function g() {
  const enum F { two }
  let lost = 3
  fetch('/a', { method: 'PUT' })
  send({ url: '/b' }, [{ url: '/c' }])
}
"""
SYMBOLS = {
    ("a.py", "variable", "x", None), ("a.py", "class", "A", None), ("a.py", "variable", "kind", "A"), ("a.py", "method", "run", "A"), ("a.py", "function", "top", None),
    ("b.ts", "variable", "from", None), ("b.ts", "variable", "more", None), ("b.ts", "class", "P", None), ("b.ts", "method", "m", "P"), ("b.ts", "method", "z", "P"), ("b.ts", "enum", "E", None),
    ("b.ts", "function", "g", None), ("b.ts", "enum", "F", "g"),
}


def found(spark, *rows):
    return tokens.tokens(files.from_rows(spark, [*rows]))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_statements_that_may_declare_are_put_together(spark):
    rows = found(spark, ("a.py", PY), ("b.ts", TS))
    got = {tuple(r) for r in extract.symbols(rows).select("file", "kind", "name", "enclosing").collect()}
    assert got == SYMBOLS
    unread = {r["t"] for r in rows.where("not declaring and stmt >= 0").groupBy("file", "stmt").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("t")).collect()}
    assert {"x . y = 2", "local = [ 1 , 2 , f ( 3 ) ]", "return local", "let lost = 3"} <= unread
    assert not [t for t in unread if re.match(r"(export|class|def|async|function|abstract|const enum) ", t)]
    assert plan(extract.symbols(rows)).count("collect_list") == 0  # what declares was written once


def test_arguments_and_objects_are_read_apart(spark):
    rows = found(spark, ("b.ts", TS), ("c.py", "requests.get('/p', headers={'url': '/q'})\n"))
    got = extract.http_calls(rows)
    assert {(r["callee"], r["method"], r["url_value"], r["from_config"]) for r in got.collect()} == {("fetch", "PUT", "/a", False), ("send", None, "/b", True), ("requests.get", "GET", "/p", False)}
    assert "= {)" not in "".join(x for x in plan(got).splitlines() if "Filter" in x and "kind" in x and "open" in x)  # braces are told by the arguments, not by one more scan
    assert plan(got).count("Relation [") <= 5


def test_files_that_come_twice_are_counted_as_before(spark):
    rows = found(spark, ("a.py", PY), ("a.py", PY), ("b.ts", "import { a } from 'x'\n"), ("b.ts", "import { a } from 'x'\n"))
    assert extract.symbols(rows).where("name = 'x' and kind = 'variable'").count() == 0
    assert extract.imports(rows).where("file = 'b.ts'").count() == extract.imports(rows).where("file = 'b.ts'").select("local").count() > 0
