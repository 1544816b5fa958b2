"""Paths and URLs as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright import schemas

_AUTHORITY = r"(?s)^([A-Za-z0-9+.\-]+)://([^/]*)(.*)$"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are evaluated once a row, however often later ones use them.

    Exploding an array of one keeps the optimizer from copying a long expression into each place that names it.
    """
    packed = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__once")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, packed).select(*kept, *(F.col("__once")[n].alias(n) for n in columns))


def null() -> Column:
    return F.lit(None).cast("string")


def scheme(url: Column) -> Column:
    """Lower-cased scheme of ``scheme://...``, else null."""
    return F.when(url.rlike(_AUTHORITY), F.lower(F.regexp_extract(url, _AUTHORITY, 1)))


def authority(url: Column) -> Column:
    """What stands between :// and the next slash, untouched; null without a scheme."""
    return F.when(url.rlike(_AUTHORITY), F.regexp_extract(url, _AUTHORITY, 2))


def after_authority(url: Column) -> Column:
    return F.when(url.rlike(_AUTHORITY), F.regexp_extract(url, _AUTHORITY, 3)).otherwise(url)


def before(text: Column, mark: str) -> Column:
    """Text before the first mark, all of it without one."""
    return F.substring_index(text, mark, 1)


def behind(text: Column, mark: str) -> Column:
    """Text behind the first mark, null without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.instr(text, mark) + 1, F.length(text)))


def fragment(rest: Column) -> Column:
    return behind(rest, "#")


def query(rest: Column) -> Column:
    """The query of what follows the authority; the fragment is cut first."""
    return behind(before(rest, "#"), "?")


def plain_path(rest: Column) -> Column:
    return before(before(rest, "#"), "?")


def segments(path: Column) -> Column:
    """Non-empty parts between slashes."""
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def trailing_slash(path: Column) -> Column:
    return (F.length(path) > 1) & F.endswith(path, F.lit("/"))


def interior_empties(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda s: s == ""))


def segment(kind: str, **fields: Column) -> Column:
    """A segment of this kind; fields that are not given are null."""
    return F.struct(F.lit(kind).alias("kind"), *(fields.get(k, null()).alias(k) for k in ("value", "name", "constraint", "source")))


def static_segment(s: Column) -> Column:
    return segment("static", value=s)


def _some(s: Column) -> Column:
    return F.when(s != "", s)


def classify_segment(s: Column) -> Column:
    """A segment of a declared route: wildcard, parameter or static.

    ``*`` and ``**``; ``{name:constraint}``; ``<constraint:name>``; ``:name``. The constraint ``path`` makes a wildcard.
    """
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    colon = F.contains(inner, F.lit(":"))
    left, right = before(inner, ":"), behind(inner, ":")
    braces = (F.length(s) >= 2) & F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}"))
    angles = (F.length(s) >= 2) & F.startswith(s, F.lit("<")) & F.endswith(s, F.lit(">"))
    name = F.when(~colon, _some(inner)).when(braces, _some(left)).otherwise(_some(right))
    limit = F.when(colon & braces, _some(right)).when(colon, _some(left))
    return (
        F.when(s.isin("*", "**"), segment("wildcard"))
        .when((braces | angles) & F.coalesce(limit == "path", F.lit(False)), segment("wildcard", name=name))
        .when(braces | angles, segment("parameter", name=name, constraint=limit))
        .when(F.startswith(s, F.lit(":")) & (F.length(s) > 1), segment("parameter", name=F.substring(s, F.lit(2), F.length(s))))
        .otherwise(static_segment(s))
    )


def looks_like_regex(path: Column) -> Column:
    return path.rlike(r"[\^$\\\[\]+?()]")


def parse_method(name: Column) -> Column:
    """One of the known verbs in upper case, else null."""
    upper = F.upper(name)
    return F.when(upper.isin(*schemas.METHODS), upper)


def method_set(names: Column) -> Column:
    """Sorted distinct verbs; null (unknown) where none is known, never an empty set."""
    known = F.array_sort(F.array_distinct(F.array_compact(F.transform(names, parse_method))))
    return F.when(F.size(known) > 0, known)


def show_methods(methods: Column) -> Column:
    return F.coalesce(F.array_join(methods, "|"), F.lit("UNKNOWN"))


def methods_compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | F.arrays_overlap(a, b)


def show_segment(s: Column) -> Column:
    return (
        F.when(s["kind"] == "static", s["value"])
        .when((s["kind"] == "parameter") & s["name"].isNotNull(), F.concat(F.lit("{"), s["name"], F.lit("}")))
        .when((s["kind"] == "wildcard") & s["name"].isNotNull(), F.concat(F.lit("{"), s["name"], F.lit("...}")))
        .when(s["kind"] == "wildcard", "{**}")
        .otherwise("{*}")
    )


def display(parts: Column, slash: Column, scheme_: Column | None = None, authority_: Column | None = None) -> Column:
    """The route as people read it."""
    path = F.concat(F.lit("/"), F.array_join(F.transform(parts, show_segment), "/"))
    path = F.when((F.size(parts) > 0) & slash, F.concat(path, F.lit("/"))).otherwise(path)
    if scheme_ is None or authority_ is None:
        return path
    return F.concat(F.coalesce(F.concat(scheme_, F.lit("://"), authority_), F.lit("")), path)


def shape(parts: Column, slash: Column) -> Column:
    """The route with the names of variables erased."""
    erased = F.transform(parts, lambda s: F.when(s["kind"] == "static", s["value"]).when(s["kind"] == "wildcard", "{**}").otherwise("{*}"))
    body = F.array_join(F.transform(erased, lambda s: F.concat(F.lit("/"), s)), "")
    return F.when((body == "") | slash, F.concat(body, F.lit("/"))).otherwise(body)


def same_shape(a: Column, b: Column) -> Column:
    """Equal lengths, equal static segments, variables aligned with variables."""
    agree = F.zip_with(
        a, b, lambda x, y: ((x["kind"] == "static") == (y["kind"] == "static")) & ((x["kind"] != "static") | (x["value"] == y["value"]))
    )
    return (F.size(a) == F.size(b)) & F.forall(agree, lambda x: F.coalesce(x, F.lit(False)))


def join_paths(prefix: Column, path: Column) -> Column:
    """prefix + path with one slash between; an empty path leaves the prefix, ``/`` gives it a slash."""
    left = F.regexp_replace(prefix, "/$", "")
    return (
        F.when(path == "", left)
        .when(path == "/", F.concat(left, F.lit("/")))
        .when(F.startswith(path, F.lit("/")), F.concat(left, path))
        .otherwise(F.concat(left, F.lit("/"), path))
    )


def language(path: Column) -> Column:
    """Source language by file extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), null())
    for k, v in schemas.EXTENSIONS.items():
        out = out.when(ext == k, v)
    return out


def valid_location(path: Column, line: Column) -> Column:
    """Repo-relative, without .. and from line 1."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    climbs = F.array_contains(F.split(norm, "/", -1), "..")
    return (F.trim(path) != "") & ~F.startswith(norm, F.lit("/")) & ~norm.rlike("^[A-Za-z]:") & ~climbs & (line >= 1)


def suffix_match(file: Column, wanted: Column) -> Column:
    """Whether wanted is the end of file in whole segments."""
    w = F.regexp_replace(wanted, r"^\./", "")
    return (file == w) | F.endswith(file, F.concat(F.lit("/"), w))


def fold_relative(directory: Column, spec: Column) -> Column:
    """directory joined with a relative path; null where it climbs past the root."""
    start = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/", -1))

    def step(at: Column, s: Column) -> Column:
        return (
            F.when(at.isNull() | s.isin("", "."), at)
            .when((s == "..") & (F.size(at) == 0), F.lit(None).cast("array<string>"))
            .when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
            .otherwise(F.array_append(at, s))
        )

    return F.array_join(F.aggregate(F.split(spec, "/", -1), start, step), "/")


def directory(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")), F.regexp_extract(file, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def valid_commit(value: Column) -> Column:
    """Lower-cased hexadecimal commit id of 7 to 64 digits, else null."""
    return F.when(value.rlike("^[0-9A-Fa-f]{7,64}$"), F.lower(value))


def valid_confidence(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & value.between(0, 1)


def environment_variable(source: Column) -> Column:
    """Name of the environment variable an expression reads; its value never is."""
    pattern = r"""^(?:process\.env\.|import\.meta\.env\.|os\.environ\[["']|os\.environ\.get\(["']|os\.getenv\(["'])([A-Za-z_][A-Za-z0-9_]*)"""
    return _some(F.regexp_extract(F.trim(source), pattern, 1))


def quoted_literal(source: Column) -> Column:
    s = F.trim(source)
    return F.when(s.rlike(r"""(?s)^(['"`])((?!\1).)*\1$"""), F.substring(s, F.lit(2), F.length(s) - 2))


def plain_identifier(source: Column) -> Column:
    """Whether an expression is one name."""
    return F.trim(source).rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
