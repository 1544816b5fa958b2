"""Facts of TypeScript and Python source, read from its token table.

A statement is a row with its code, tokens a blank apart, strings and templates standing as the numbers of their tokens; an item is what stands between
two commas of a bracket. Calls, requests, routes and the rest are joins of these by file and token. What does not parse yields nothing, its
neighbours still do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright import schemas
from edgewright.operators.rounds import kept

# Fixed values.
HTTP_OBJECTS = {"typescript": ("axios", "client", "http", "api"), "python": ("requests", "httpx", "session", "client", "http", "aiohttp")}
ROUTE_OBJECTS = ("app", "router", "api", "blueprint", "bp")
#: Diagnostics of a file that are told one by one; one more row says that there are others.
MOST_DIAGNOSTICS = 25

_NAME = r"[#\w$]+"
_TS = "language <> 'python'"


def statements(tokens: DataFrame) -> DataFrame:
    """(file, language, stmt, line, code, strings, scopes, in_class, parent, decorator): a row for each statement; ``strings`` has its strings (seq, value) in order.

    The code of a body stands in statements of its own, and so do expressions in templates, which are left out here.
    """
    # A statement is numbered by its first token, which alone brings more than its text; strings are a list of their own, so that what needs none collects none.
    first = F.min(F.when(F.col("seq") == F.col("stmt"), F.struct("text", "kind", "value", "line", "scopes", "in_class", "parent", "decorator")))
    listed = lambda one: F.sort_array(F.collect_list(one))
    rows = tokens.where("stmt >= 0").groupBy("file", "language", "stmt").agg(first.alias("f"), listed(F.struct("seq", "text")).alias("t"), listed(F.when(F.col("kind") == "string", F.struct("seq", "value"))).alias("strings"))
    return rows.select("file", "language", "stmt", F.col("f.line").alias("line"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("code"), "strings", *(F.col(f"f.{c}").alias(c) for c in ("scopes", "in_class", "parent", "decorator")))


def _string(pattern: str) -> Column:
    """The string of a statement whose token the group of the pattern finds in its code."""
    return F.get(F.filter("strings", lambda x: x["seq"].cast("string") == F.regexp_extract("code", pattern, 1)), F.lit(0))["value"]


def items(tokens: DataFrame) -> DataFrame:
    """(file, parent, arg, key, kind, value, parts, texts, n, inner, dotted, called, strings): what stands at each place of a bracket.

    ``key`` is the name before ``=`` or ``:``; then ``kind`` is literal or template for a single string or template, else dynamic. ``inner`` is the bracket
    that the value consists of, ``dotted`` the value if it is a chain of names, ``called`` that chain where a call ends it.
    """
    one = F.struct("seq", "kind", "text", "value", "parts")
    rows = tokens.where("arg >= 0").groupBy("file", "language", "parent", "arg").agg(F.sort_array(F.collect_list(one)).alias("t"))
    t0, t1 = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    keyed = F.coalesce(t0["kind"].isin("name", "string") & (t1["text"] == F.when(F.col("language") == "python", F.when(t0["kind"] == "name", "=").otherwise(":")).otherwise(":")), F.lit(False))
    rows = rows.withColumns({"key": F.when(keyed, F.coalesce(t0["value"], t0["text"])), "v": F.when(keyed, F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).otherwise(F.col("t"))})
    v0, n, last = F.get("v", F.lit(0)), F.size("v"), F.try_element_at("v", F.lit(-1))
    chain = F.forall("v", lambda x: (x["kind"] == "name") | x["text"].isin(".", "?."))
    texts = F.transform("v", lambda x: x["text"])
    call = (n > 2) & (last["text"] == ")") & F.forall(F.slice("v", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: (x["kind"] == "name") | x["text"].isin(".", "?."))
    kind = F.when((n == 1) & (v0["kind"] == "string"), "literal").when((n == 1) & (v0["kind"] == "template"), "template").otherwise("dynamic")
    return rows.select(
        "file", "parent", "arg", "key", kind.alias("kind"), F.when(kind == "literal", v0["value"]).alias("value"), F.when(kind == "template", v0["parts"]).alias("parts"), texts.alias("texts"), n.alias("n"),
        F.when((n == 2) & (v0["kind"] == "open"), v0["seq"]).alias("inner"), F.when(chain & (n > 0), F.array_join(texts, "")).alias("dotted"), F.when(call, F.array_join(F.slice(texts, F.lit(1), F.greatest(n - 2, F.lit(0))), "")).alias("called"),
        F.when((n > 0) & F.forall("v", lambda x: x["kind"].isin("string", "template")), F.coalesce(v0["value"], F.get(v0["parts"], F.lit(0))["value"])).alias("strings"),
    )


def _arguments(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Calls that have arguments, with ``args``: their items in order."""
    fields = ["arg", "key", "kind", "value", "parts", "texts", "n", "inner", "dotted", "called", "strings"]
    listed = found.groupBy("file", F.col("parent").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("arg", F.struct(*fields[1:]).alias("i")))).alias("args"))
    return calls.join(listed.withColumn("args", F.transform("args", lambda x: x["i"])), ["file", "seq"])


def _calls(tokens: DataFrame) -> DataFrame:
    """Opening brackets of calls, with their callee as a ``path``; those of Python's decorators and of the heads of functions and classes are none."""
    rows = tokens.where("callee is not null and not decorator and not header")
    return rows.select("file", "language", F.col("call_line").alias("line"), "seq", "stmt", "scopes", "parent", "callee", "chained", "fresh", F.split("callee", r"\.").alias("path"))


def imports(tokens: DataFrame) -> DataFrame:
    """(file, line, specifier, imported, local): one row for each bound name; ``*`` for namespaces and wildcards, null names for side effects."""
    rows = statements(tokens.where("head in ('import', 'export', 'from')")).withColumn("values", F.map_from_entries(F.transform("strings", lambda x: F.struct(x["seq"].cast("string"), x["value"]))))
    none, code = F.lit(None).cast("string"), F.col("code")
    group = lambda p, k: F.nullif(F.regexp_extract(code, p, k), F.lit(""))
    each = lambda text: F.explode(F.filter(F.transform(F.split(text, r" ?, ?"), lambda x: F.trim(x)), lambda x: x != "")).alias("item")
    part = lambda p, k: F.nullif(F.regexp_extract("item", p, k), F.lit(""))
    py, ts = rows.where("language = 'python'"), rows.where(_TS)
    whole = py.where(code.rlike("^import ")).select("file", "line", each(F.substring(code, F.lit(8), F.length(code))))
    named_as = r"^(.+?)(?: as (\w+))?$"
    specifier = F.replace(part(named_as, 1), F.lit(" "), F.lit(""))
    out = whole.select("file", "line", specifier.alias("specifier"), F.lit("*").alias("imported"), F.coalesce(part(named_as, 2), specifier).alias("local"))
    names = r"^from ((?:\. )*[\w .]*?) ?import (?:\( )?(.*?)(?: \))?$"
    some = py.where(code.rlike(names)).select("file", "line", F.replace(group(names, 1), F.lit(" "), F.lit("")).alias("specifier"), each(group(names, 2)))
    out = out.unionByName(some.select("file", "line", "specifier", part(named_as, 1).alias("imported"), F.coalesce(part(named_as, 2), part(named_as, 1)).alias("local")))
    source = r'^(?:import|export) .*\bfrom "(\d+)"'
    bound = ts.where(code.rlike(source)).withColumn("specifier", F.col("values")[F.regexp_extract(code, source, 1)])
    inner = r"^(?:type )?([\w$]+)(?: as ([\w$]+))?$"
    named = bound.select("file", "line", "specifier", each(F.regexp_extract(code, r"\{ (.*?) ?\}", 1)))
    out = out.unionByName(named.select("file", "line", "specifier", part(inner, 1).alias("imported"), F.coalesce(part(inner, 2), part(inner, 1)).alias("local")))
    default = group(rf"^import (?:type )?({_NAME}) (?:,|from)", 1)
    out = out.unionByName(bound.withColumn("local", default).where("local is not null and local <> 'type'").select("file", "line", "specifier", F.lit("default").alias("imported"), "local"))
    star = bound.where(code.rlike(r"^\w+ (?:type )?(?:[\w$]+ , )?\*")).select("file", "line", "specifier", F.lit("*").alias("imported"), F.coalesce(group(rf"\* as ({_NAME})", 1), F.lit("*")).alias("local"))
    bare = r'^import "(\d+)"'
    side = ts.where(code.rlike(bare)).select("file", "line", F.col("values")[F.regexp_extract(code, bare, 1)].alias("specifier"), none.alias("imported"), none.alias("local"))
    return out.unionByName(star).unionByName(side)


_SYMBOLS = {
    "python": [("class", r"^class (\w+)"), ("function", r"^(?:async )?def (\w+)"), ("variable", r"^(\w+) (?:: .*?)?= ")],
    "typescript": [
        ("function", rf"^(?:export )?(?:default )?(?:declare )?(?:async )?function (?:\* )?({_NAME})?"),
        ("class", rf"^(?:export )?(?:default )?(?:declare )?(?:abstract )?class (?!extends)({_NAME})?"),
        ("interface", rf"^(?:export )?(?:default )?(?:declare )?interface ({_NAME})"),
        ("type-alias", rf"^(?:export )?(?:declare )?type ({_NAME}) [=<]"),
        ("enum", rf"^(?:export )?(?:declare )?(?:const )?enum ({_NAME})"),
    ],
}
_METHOD = rf"^(?:(?:public|private|protected|static|async|override|readonly|get|set|\*) )*({_NAME}) (?:< [^()]* > )?\("


def symbols(tokens: DataFrame) -> DataFrame:
    """(file, language, stmt, line, kind, name, enclosing, is_async, exported, bases) of declarations.

    ``enclosing`` is the innermost function, class or method around. Variables are those of a module, and of a Python class body; TypeScript's arrow functions
    open no scope, and destructured names are none. A nameless default export is called ``default``.
    """
    rows, code = statements(tokens.where("declaring")), F.col("code")
    rows = rows.withColumns({"outer": F.try_element_at("scopes", F.lit(-1)), "local": F.size("scopes") > 0})
    kind = name = F.lit(None).cast("string")
    for language, found in _SYMBOLS.items():
        of = F.col("language") == "python" if language == "python" else F.col("language") != "python"
        for k, p in reversed(found):
            hit = of & code.rlike(p) & ((~F.col("local") | F.col("in_class")) if k == "variable" else F.lit(True))
            given = F.nullif(F.regexp_extract(code, p, 1), F.lit(""))
            kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.coalesce(given, F.when(code.rlike("^export default "), "default"))).otherwise(name)
    method = (F.col("language") != "python") & F.col("in_class") & code.rlike(_METHOD) & code.rlike(r"\} ?$") & ~code.rlike(r"^[^(]*=")
    kind, name = F.when(method, "method").otherwise(kind), F.when(method, F.regexp_extract(code, _METHOD, 1)).otherwise(name)
    kind = F.when((kind == "function") & (F.col("language") == "python") & F.col("in_class"), "method").otherwise(kind)
    listed = F.regexp_extract(code, r"^class \w+ \( (.*?)(?: ,)? \) :", 1)
    bases = F.filter(F.transform(F.split(listed, " ?, ?"), lambda b: F.replace(b, F.lit(" "), F.lit(""))), lambda b: (b != "") & ~F.contains(b, F.lit("=")))
    head = ["file", "language", "stmt", "line", "outer"]
    begins = (F.col("language") != "python") & code.rlike("^(?:export )?(?:declare )?(?:const|let|var) ") & ~F.col("local") & ~code.rlike("^(?:export )?const enum ")
    # Three steps read the statements that declare something: written once, so that the code of all statements is put together once.
    told = rows.select(*head, "parent", kind.alias("kind"), name.alias("name"), code.rlike(r"^(?:\w+ )*?async ").alias("is_async"), code.rlike("^export ").alias("exported"), bases.alias("bases"), begins.alias("begins"))
    told = kept(told.where("name is not null or begins"), "declarations").hint("merge")
    made = told.where("name is not null").drop("parent", "begins")
    # Declarators: names behind const, let or var, or behind a comma of that statement's own level.
    level = Window.partitionBy("file", "stmt", "parent").orderBy("seq")
    begins = told.where("begins").select(*head, F.col("parent").alias("level"), "exported")
    beside = tokens.where(f"stmt >= 0 and {_TS} and head in ('export', 'declare', 'const', 'let', 'var')").withColumns({"ahead": F.lag("text").over(level), "behind": F.lead("text").over(level)})
    beside = beside.where("kind = 'name' and ahead in ('const', 'let', 'var', ',') and (behind is null or behind in ('=', ':', ',', '!', 'of', 'in'))").select("file", "stmt", F.col("parent").alias("level"), F.col("line").alias("at"), F.col("text").alias("name"))
    each = begins.join(beside, ["file", "stmt", "level"]).select(*(c for c in head if c != "line"), F.col("at").alias("line"), F.lit("variable").alias("kind"), "name", F.lit(False).alias("is_async"), "exported", F.array().cast("array<string>").alias("bases"))
    made = made.unionByName(each)
    scopes = made.where("kind in ('function', 'class', 'method')").select("file", F.col("stmt").alias("outer"), F.col("name").alias("enclosing")).hint("merge")
    return made.join(scopes, ["file", "outer"], "left").select("file", "language", "stmt", "line", "kind", "name", "enclosing", "is_async", "exported", "bases")


def with_exports(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Symbols with ``exported`` also true where a later statement exports them by name: ``export { a }``, ``export default a``, ``__all__``.

    Only symbols of the module's own scope can be meant; ``export { a } from`` names another module's.
    """
    rows, code = statements(tokens.where("head in ('export', '__all__')")), F.col("code")
    braces, default, listed = r"^export (?:type )?\{ (.*?) ?\}$", rf"^export default ({_NAME})$", r"^__all__ (?:: .*?)?\+?= [\[(] (.*) [\])]$"
    each = F.explode(F.split(F.regexp_extract(code, braces, 1), r" ?, ?")).alias("name")
    named = rows.where(_TS).where(code.rlike(braces)).select("file", each).select("file", F.regexp_extract("name", r"^(?:type )?([\w$]+)", 1).alias("name"))
    single = rows.where(_TS).where(code.rlike(default)).select("file", F.regexp_extract(code, default, 1).alias("name"))
    public = rows.where("language = 'python'").where(code.rlike(listed)).select("file", F.explode("strings.value").alias("name"))
    later = named.unionByName(single).unionByName(public).distinct().withColumn("__later", F.lit(True)).hint("merge")
    joined = found.join(later, ["file", "name"], "left")
    return joined.withColumn("exported", F.col("exported") | (F.coalesce("__later", F.lit(False)) & F.col("enclosing").isNull())).select(*found.columns)


def spans(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Functions, classes and methods with ``start`` and ``end``, the lines of their first and last token."""
    blocks = found.where("kind in ('function', 'class', 'method')").withColumnRenamed("line", "start")
    own = tokens.select("file", F.explode(F.array_append("scopes", F.col("stmt"))).alias("stmt"), "end_line").groupBy("file", "stmt").agg(F.max("end_line").alias("end"))
    return blocks.join(own, ["file", "stmt"])


def tables(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add ``table`` to the Python classes of spans(): the literal ``__tablename__`` of a class, else ``db_table`` of a class in it; null where none is stated."""
    rows, code = statements(tokens.where("language = 'python' and head in ('__tablename__', 'db_table')")).where("in_class"), F.col("code")
    stated = r'^(?:__tablename__|db_table) (?:: .*?)?= "(\d+)"$'
    rows = rows.where(code.rlike(stated)).withColumn("table", _string(stated))
    holder = F.when(F.startswith(code, F.lit("__tablename__")), F.try_element_at("scopes", F.lit(-1))).otherwise(F.try_element_at("scopes", F.lit(-2)))
    first = rows.select("file", holder.alias("holder"), F.col("stmt").alias("at"), "table").where("holder is not null").groupBy("file", F.col("holder").alias("stmt")).agg(F.min_by("table", "at").alias("table"))
    return classes.where("kind = 'class'").drop("table").join(first, ["file", "stmt"], "left")


def _objects(found: DataFrame) -> DataFrame:
    """(file, inner, url, method) of objects by their bracket: the first ``url`` or ``endpoint``, and the value of ``method`` if it is a literal."""
    value = F.struct("arg", "kind", "value", "parts")
    url = F.min(F.when(F.col("key").isin("url", "endpoint"), value))
    method = F.min(F.when(F.col("key") == "method", F.struct("arg", "value")))
    return found.where("key in ('url', 'endpoint', 'method')").groupBy("file", F.col("parent").alias("inner")).agg(url.alias("url"), method["value"].alias("method"))


def _verb(name: Column) -> Column:
    return F.when(F.upper(name).isin(*schemas.METHODS), F.upper(name))


def _like_path(kind: Column, value: Column, parts: Column) -> Column:
    """Whether a literal, or the text a template begins with, is a path or a URL."""
    head = F.when(kind == "literal", value).when(kind == "template", F.get(parts, F.lit(0))["value"])
    return F.coalesce(F.startswith(head, F.lit("/")) | head.rlike("^https?://"), F.lit(False))


def http_calls(tokens: DataFrame) -> DataFrame:
    """(file, language, line, seq, callee, scope, method, url_kind, url_value, url_parts, from_config, url_source): client requests.

    ``fetch``, verbs of known HTTP objects, verbs of any object with a path-like first argument, and in TypeScript calls with an object that has a path-like
    ``url`` or ``endpoint``. A verb of an unknown object whose other arguments may all be handlers declares a route and is no request. ``scope`` is
    the statement of the function around, ``url_source`` the expression of a dynamic URL.
    """
    # What stands in the brackets of calls is read as arguments alone, what stands in others as objects alone, and those only where they say something.
    rows = _arguments(_calls(tokens).where("not fresh"), items(tokens.where("holder is not null")))
    spread = rows.where(_TS).select("file", "seq", F.posexplode("args").alias("at", "i")).where((F.get("i.texts", F.lit(0)) == "{") & F.col("i.inner").isNotNull()).select("file", "seq", "at", F.col("i.inner").alias("inner"))
    told = spread.join(_objects(items(tokens.where(f"holder is null and {_TS}"))), ["file", "inner"], "left")
    objects = told.groupBy("file", "seq").agg(F.sort_array(F.collect_list(F.struct("at", "url", "method"))).alias("objects")).hint("merge")
    rows = rows.join(objects, ["file", "seq"], "left")
    like = lambda o: _like_path(o["url"]["kind"], o["url"]["value"], o["url"]["parts"])
    # The first object must say a URL, or no later one is looked at.
    fit = lambda o, i: like(o) & F.forall(F.slice("objects", F.lit(1), i), lambda x: x["url"].isNotNull())
    config = F.when(F.col("language") != "python", F.get(F.filter("objects", fit), F.lit(0)))
    prop, python = F.element_at("path", -1), F.col("language") == "python"
    first = F.when(python, F.get(F.filter("args", lambda a: a["key"].isNull()), F.lit(0))).otherwise(F.get("args", F.lit(0)))
    rows = rows.withColumns({"config": config, "first": first, "verb": _verb(prop)})
    known = F.when(python, F.get("path", F.size("path") - 2).isin(*HTTP_OBJECTS["python"])).otherwise((F.size("path") == 2) & F.col("path")[0].isin(*HTTP_OBJECTS["typescript"]))
    handler = lambda a: a["called"].isNotNull() | F.array_contains(a["texts"], "=>") | F.coalesce(F.get(a["texts"], F.lit(0)).isin("function", "async"), F.lit(False)) | (a["dotted"].isNotNull() & ~a["dotted"].isin("null", "true", "false", "this"))
    handlers = ~python & (F.size("args") > 1) & F.forall(F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))), handler)
    fetch = ~python & (F.col("callee") == "fetch")
    member = (F.size("path") > 1) & F.col("verb").isNotNull() & (known | ~handlers) & (known | _like_path(F.col("first.kind"), F.col("first.value"), F.col("first.parts")))
    asked = F.filter("objects", lambda o: o["at"] == 1)
    plain = F.col("chained") & F.col("first").isNotNull() & (fetch | member)
    by_config = F.col("config").isNotNull()
    method = F.when(by_config, F.coalesce(_verb(F.col("config.method")), F.col("verb"))).when(fetch, _verb(F.get(asked, F.lit(0))["method"])).otherwise(F.col("verb"))
    pick = lambda field: F.when(by_config, F.col(f"config.url.{field}")).otherwise(F.col(f"first.{field}"))
    return rows.where(by_config | F.coalesce(plain, F.lit(False))).select(
        "file", "language", "line", "seq", "callee", F.try_element_at("scopes", F.lit(-1)).alias("scope"), method.alias("method"), pick("kind").alias("url_kind"), pick("value").alias("url_value"), pick("parts").alias("url_parts"), by_config.alias("from_config"), F.when(~by_config & (F.col("first.kind") == "dynamic"), F.coalesce("first.dotted", F.array_join("first.texts", " "))).alias("url_source")
    )


def config_requests(tokens: DataFrame) -> DataFrame:
    """The requests of http_calls() that an argument object states."""
    return http_calls(tokens).where("from_config")


def build_aliases(tokens: DataFrame) -> DataFrame:
    """(dir, alias, target) of ``resolve: { alias: { name: "folder" } }`` in TypeScript; values that are no literals are left out."""
    found = items(tokens.where(_TS))
    outer = found.where("key = 'resolve' and inner is not null").select("file", F.col("inner").alias("parent"))
    alias = found.where("key = 'alias' and inner is not null").join(outer, ["file", "parent"]).select("file", F.col("inner").alias("parent")).hint("merge")
    pairs = found.where("key is not null and kind = 'literal'").join(alias, ["file", "parent"])
    target, directory = F.regexp_replace("value", r"^\./", ""), F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    return pairs.select(directory.alias("dir"), F.col("key").alias("alias"), F.when(directory == "", target).otherwise(F.concat_ws("/", directory, target)).alias("target"))


def _positional(k: int) -> Column:
    return F.get(F.filter("args", lambda a: a["key"].isNull()), F.lit(k))


def _keyword(name: str) -> Column:
    return F.get(F.filter("args", lambda a: a["key"] == name), F.lit(0))


def routes(tokens: DataFrame) -> DataFrame:
    """(file, language, line, seq, style, methods, path_kind, path_value, path_parts, receiver, handler): Python's route declarations.

    Decorators named for a verb or ``route``, of a known registrar or with a literal that begins with a slash as first positional argument, and URL conf entries with a
    string for pattern. Joined strings are dynamic. Methods that are none of the verbs go; a list that is not literal says nothing.
    """
    py = tokens.where("language = 'python'")
    # Only decorators, what they decorate, and the brackets of decorators and entries are put together.
    entries = F.substring_index("holder", ".", -1).isin("path", "re_path")
    found, stmts = items(py.where(F.col("decorator") | entries)), statements(py.where("head in ('@', 'async', 'def', 'class')"))
    order = Window.partitionBy("file").orderBy(F.col("stmt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    define = F.nullif(F.regexp_extract("code", r"^(?:async )?(?:def|class) (\w+)", 1), F.lit(""))
    handlers = stmts.select("file", "stmt", "decorator", "code", "parent", F.last(define, ignorenulls=True).over(order).alias("handler")).where("decorator").withColumnRenamed("parent", "level")
    calls = py.where("callee is not null and decorator and chained").select("file", "language", "line", "seq", "stmt", F.col("parent").alias("level"), "callee")
    made = _arguments(calls.join(handlers, ["file", "stmt", "level"]), found).withColumns({"first": _positional(0), "listed": _keyword("methods"), "path": F.split("callee", r"\.")})
    made = made.where(F.col("code").rlike(r"^@ [\w .]+ \(") & (F.size("path") > 1) & F.col("first").isNotNull())
    verb, base = F.element_at("path", -1), F.col("path")[0]
    registrar = (F.size("path") == 2) & (base.isin(*ROUTE_OBJECTS) | F.endswith(base, F.lit("_router")) | F.endswith(base, F.lit("_app")))
    made = made.where((registrar | F.coalesce(F.startswith("first.strings", F.lit("/")), F.lit(False))) & ((verb == "route") | _verb(verb).isNotNull()))
    listed = found.where("kind = 'literal' and key is null").select("file", F.col("parent").alias("inner"), "arg", _verb(F.col("value")).alias("verb")).where("verb is not null")
    listed = listed.groupBy("file", "inner").agg(F.transform(F.sort_array(F.collect_list(F.struct("arg", "verb"))), lambda x: x["verb"]).alias("verbs"))
    made = made.withColumn("inner", F.col("listed.inner")).join(listed, ["file", "inner"], "left")
    methods = F.when(verb == "route", F.coalesce("verbs", F.array().cast("array<string>"))).otherwise(F.array(_verb(verb)))
    receiver = F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), ".")
    made = made.select("file", "language", "line", "seq", F.lit("decorator").alias("style"), methods.alias("methods"), F.col("first.kind").alias("path_kind"), F.col("first.value").alias("path_value"), F.col("first.parts").alias("path_parts"), receiver.alias("receiver"), "handler")
    entry = _arguments(_calls(py).where("chained").where(F.element_at("path", -1).isin("path", "re_path")), found).withColumns({"first": _positional(0), "second": _positional(1)}).where("first.strings is not null")
    none = F.lit(None).cast("string")
    entry = entry.select("file", "language", "line", "seq", F.lit("url-conf-entry").alias("style"), F.array().cast("array<string>").alias("methods"), F.col("first.kind").alias("path_kind"), F.col("first.value").alias("path_value"), F.col("first.parts").alias("path_parts"), none.alias("receiver"), F.coalesce("second.dotted", "second.called").alias("handler"))
    return made.unionByName(entry)


def routers(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routers, inclusions): ``x = ...Router(prefix=...)`` and ``x.include_router(y, prefix=...)``; a prefix that is no literal is unresolved.

    Routers are variables of a module or class; an included router must be named, not built in place.
    """
    py = tokens.where("language = 'python'")
    found, calls = items(py.where(F.col("holder").rlike(r"Router$|(?:^|\.)include_router$"))), _calls(py).where("chained")
    listed = found.where("key = 'prefix'").select("file", F.col("parent").alias("seq"), "kind", "value", F.lit(True).alias("given")).dropDuplicates(["file", "seq"])
    prefix = [F.when(F.col("kind") == "literal", F.col("value")).alias("prefix"), F.coalesce(F.col("given") & (F.col("kind") != "literal"), F.lit(False)).alias("prefix_unresolved")]
    assigned = r"^(\w+) (?:: .*?)?= ([\w .]+?) \( (?:.* )?\)$"
    stmts = statements(py).where(F.col("code").rlike(assigned) & ((F.size("scopes") == 0) | F.col("in_class")))
    stmts = stmts.select("file", "stmt", F.col("line").alias("at"), F.col("parent"), F.regexp_extract("code", assigned, 1).alias("name"), F.replace(F.regexp_extract("code", assigned, 2), F.lit(" "), F.lit("")).alias("callee"))
    made = calls.where(F.endswith(F.element_at("path", -1), F.lit("Router"))).drop("line").join(stmts, ["file", "stmt", "parent", "callee"]).join(listed, ["file", "seq"], "left")
    declared = made.select("file", F.col("at").alias("line"), "name", *prefix)
    put = _arguments(calls.where((F.size("path") > 1) & (F.element_at("path", -1) == "include_router")), found).withColumn("child", _positional(0)["dotted"]).where("child is not null").join(listed, ["file", "seq"], "left")
    parent = F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), ".")
    return declared, put.select("file", "line", parent.alias("parent"), "child", *prefix)


def calls(tokens: DataFrame) -> DataFrame:
    """(file, line, seq, callee, root, path, property, is_new, argument_count, scope): calls by plain name or unbroken chain of names."""
    count = items(tokens.where("holder is not null")).groupBy("file", F.col("parent").alias("seq")).agg(F.count("*").alias("argument_count"))
    rows = _calls(tokens).where("chained").join(count, ["file", "seq"], "left")
    fresh = F.col("fresh") & (F.col("language") != "python")
    return rows.select("file", "line", "seq", "callee", F.col("path")[0].alias("root"), "path", F.when(F.size("path") > 1, F.element_at("path", -1)).alias("property"), fresh.alias("is_new"), F.coalesce("argument_count", F.lit(0)).cast("int").alias("argument_count"), F.try_element_at("scopes", F.lit(-1)).alias("scope"))


def _chains(tokens: DataFrame) -> DataFrame:
    """(file, language, line, stmt, from, to, operands): chains of ``+`` with a string among their operands, each operand by its first and last token.

    Operators that bind closer stay within an operand, all others, commas and words end the chain.
    """
    level = Window.partitionBy("file", "stmt", "parent", "arg").orderBy("seq")
    tight = F.col("text").isin(".", "?.", "*", "/", "%", "**", "//", "!", "~")
    ends = ((F.col("kind") == "op") & ~tight & (F.col("text") != "+")) | F.col("text").isin("return", "in", "of", "if", "else", "for", "and", "or", "not", "is", "await", "yield", "const", "let", "var", "export", "default", "typeof", "new", "as", "lambda", "print")
    rows = tokens.where("summed").withColumn("plus", (F.col("text") == "+").cast("int"))
    rows = rows.withColumns({"chain": F.sum(ends.cast("int")).over(level), "operand": F.sum("plus").over(level)}).where(~ends & (F.col("plus") == 0))
    one = rows.groupBy("file", "language", "stmt", "parent", "arg", "chain", "operand").agg(F.min("seq").alias("from"), F.max("seq").alias("to"), F.min("line").alias("line"), F.count("*").alias("n"), F.min_by("kind", "seq").alias("kind"))
    chain = one.groupBy("file", "language", "stmt", "parent", "arg", "chain").agg(F.sort_array(F.collect_list(F.struct("operand", "from", "to", ((F.col("n") == 1) & (F.col("kind") == "string")).alias("text")))).alias("operands"), F.min("line").alias("line"), F.min("from").alias("from"), F.max("to").alias("to"))
    return chain.where((F.size("operands") > 1) & F.exists("operands", lambda o: o["text"]))


def concatenations(tokens: DataFrame) -> DataFrame:
    """(file, line, seq, parts): chains of ``+`` with a string literal among their operands; parts (kind, value) in order."""
    found = _chains(tokens)
    # A chain's tokens are those of its statement between its first and its last.
    shown = F.when(F.col("kind") == "string", F.concat(F.lit('"'), "value", F.lit('"'))).when(F.col("kind") == "template", F.col("value")).otherwise(F.col("text"))
    listed = tokens.groupBy("file", "stmt").agg(F.sort_array(F.collect_list(F.struct("seq", shown.alias("shown"), "value"))).alias("t"))
    rows = found.join(listed, ["file", "stmt"])

    def part(o: Column) -> Column:
        own = F.filter("t", lambda x: x["seq"].between(o["from"], o["to"]))
        return F.struct(F.when(o["text"], "literal").otherwise("expression").alias("kind"), F.when(o["text"], F.get(own, F.lit(0))["value"]).otherwise(F.array_join(F.transform(own, lambda x: x["shown"]), "")).alias("value"))

    return rows.select("file", "line", F.col("from").alias("seq"), F.transform("operands", part).alias("parts"))


def strings(tokens: DataFrame) -> DataFrame:
    """(file, line, seq, value) of plain string literals, but for those of imports, decorators, heads of functions and classes, and chains of ``+``, which have facts of their own."""
    rows = tokens.where("kind = 'string' and not decorator and not header")
    sources = statements(tokens.where(F.col("head").rlike(r"^import\b|^export$"))).where(F.col("code").rlike(r'^import\b|^export .*\bfrom "\d+"')).select("file", "stmt")
    joined = _chains(tokens).select("file", "stmt", "from", "to")
    inside = rows.join(joined, ["file", "stmt"]).where(F.col("seq").between(F.col("from"), F.col("to"))).select("file", "seq").hint("merge")
    return rows.join(sources, ["file", "stmt"], "left_anti").join(inside, ["file", "seq"], "left_anti").select("file", "line", "seq", "value")


def diagnostics(tokens: DataFrame) -> DataFrame:
    """(file, kind): files whose brackets do not meet."""
    return tokens.where("fault is not null").select("file", F.lit("unbalanced-brackets").alias("kind")).distinct()


def diagnostic_places(tokens: DataFrame, most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """(file, line, kind): brackets that close what nothing opened or are never closed, the first of each file, then ``truncated``."""
    order = Window.partitionBy("file").orderBy("seq")
    found = tokens.where("fault is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    return found.select("file", F.when(F.col("place") <= most, F.col("line")).alias("line"), F.when(F.col("place") <= most, F.col("fault")).otherwise("truncated").alias("kind"))
