"""ORM models, their tables and accesses, and client call chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.operators.rounds import kept

# Fixed values.
DJANGO_BASES = ("models.Model",)
SQLALCHEMY_BASES = ("Base", "DeclarativeBase", "db.Model")
PLAIN_BASES = ("Model",)
MANAGER = "objects"
QUERY_METHODS = ("get", "filter", "all", "exclude", "count", "exists", "first", "last")
WRITE_METHODS = ("create", "update", "delete", "bulk_create")


def model_base(bases: Column) -> Column:
    """Flavour by base class: django before sqlalchemy before a plain Model; null for no model."""
    has = lambda names: F.exists(bases, lambda b: b.isin(*names))
    return F.when(has(DJANGO_BASES), "django").when(has(SQLALCHEMY_BASES), "sqlalchemy").when(has(PLAIN_BASES), "model")


def models(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, ambiguous names) of Python classes (file, name, line, bases, table): a name declared twice is no model."""
    found = classes.withColumn("flavour", model_base(F.col("bases"))).where("flavour is not null")
    counts = found.groupBy("name").agg(F.count("*").alias("declared"))
    return found.join(counts.where("declared = 1").select("name"), "name", "left_semi"), counts.where("declared > 1").select("name", "declared")


def access_kind(path: Column) -> Column:
    """What a call of this dotted path does to the model it names: ``Model(...)`` persists, ``Model.objects.x`` persists or queries
    for the known methods. Any other call is no access (null)."""
    method = F.when(F.element_at(path, -1).isin(*WRITE_METHODS), "persist").when(F.element_at(path, -1).isin(*QUERY_METHODS), "query")
    return F.when(F.size(path) == 1, "persist").when((F.size(path) == 3) & (F.get(path, F.lit(1)) == MANAGER), method)


def accesses(calls: DataFrame, known: DataFrame, variables: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Uses of models in Python calls (file, line, enclosing, root, path), with ``access`` query or persist.

    A file that binds a variable of the model's name is not looked at. ``bound`` (file, name, status, declared_in) says where a
    name leads through the file's imports: it must lead to the model's own file. Names that nothing binds (a star import)
    are let pass, as the model is then the only declaration in question.
    """
    rows = calls.where("language = 'python'") if "language" in calls.columns else calls
    named = rows.join(known.select(F.col("name").alias("root"), F.col("file").alias("model_file")).distinct(), "root")
    shadow = variables.select("file", F.col("name").alias("root")).distinct()
    found = named.join(shadow, ["file", "root"], "left_anti").withColumn("access", access_kind(F.col("path"))).where("access is not null")
    if bound is None:
        return found
    leads = bound.select("file", F.col("name").alias("root"), F.col("status").alias("__status"), "declared_in").distinct()
    met = found.join(leads, ["file", "root"], "left")
    status = F.coalesce("__status", F.lit("not-bound"))
    return met.where((status == "not-bound") | ((status == "declared") & (F.col("declared_in") == F.col("model_file")))).drop("__status", "declared_in")


def declared_tables(found: DataFrame, symbols: DataFrame, strings: DataFrame) -> DataFrame:
    """Models (file, name, flavour, start, end) with ``table`` and ``table_reason``.

    A declaration is the variable ``__tablename__`` of a sqlalchemy class itself, or ``db_table`` of a class nested in a django
    one; both must lie within the class's span, since every Django model nests a ``Meta``. Its value is the first literal
    (file, line, seq, value) on the variable's lines. Symbols are (file, kind, name, enclosing, start, end).
    """
    m = found.where("flavour in ('django', 'sqlalchemy')").select("file", F.col("name").alias("model"), "flavour", F.col("start").alias("from"), F.col("end").alias("to"))
    variables = symbols.where("kind = 'variable' and name in ('__tablename__', 'db_table') and enclosing is not null")
    own = variables.select("file", F.col("name").alias("attribute"), F.col("enclosing").alias("owner"), F.col("start").alias("at"), F.col("end").alias("until"))
    inside = (F.col("at") >= F.col("from")) & (F.col("until") <= F.col("to"))
    nested = symbols.where("kind = 'class' and enclosing is not null").select("file", F.col("name").alias("owner"), F.col("enclosing").alias("model"), F.col("start").alias("n0"), F.col("end").alias("n1"))
    alchemy = m.where("flavour = 'sqlalchemy'").join(own.where("attribute = '__tablename__'").withColumnRenamed("owner", "model"), ["file", "model"]).where(inside)
    metas = m.where("flavour = 'django'").join(nested, ["file", "model"]).where((F.col("n0") >= F.col("from")) & (F.col("n1") <= F.col("to")))
    django = metas.select("file", "model", "from", "to", "owner").join(own.where("attribute = 'db_table'"), ["file", "owner"]).where(inside)
    stated = alchemy.select("file", "model", "attribute", "at", "until").unionByName(django.select("file", "model", "attribute", "at", "until"))
    first = stated.groupBy("file", "model").agg(F.min(F.struct("at", "until", "attribute")).alias("d")).select("file", "model", "d.*")
    literals = strings.select("file", "line", "seq", "value")
    met = first.join(literals, "file", "left").where("line is null or line between at and until")
    value = met.groupBy("file", "model").agg(F.min(F.struct("line", "seq", "value")).alias("v")).select("file", "model", F.col("v.value").alias("table"))
    joined = found.join(first.join(value, ["file", "model"], "left").select("file", F.col("model").alias("name"), "attribute", "table"), ["file", "name"], "left")
    good = F.coalesce(F.length("table") > 0, F.lit(False))
    reason = (
        F.when(good, F.concat("attribute", F.lit(' = "'), "table", F.lit('"')))
        .when(F.col("attribute").isNotNull(), F.concat(F.lit("table not resolved: "), "attribute", F.lit(" is not a string literal")))
        .when(F.col("flavour") == "django", "table not resolved: no Meta.db_table; the default needs the app label")
        .when(F.col("flavour") == "sqlalchemy", "table not resolved: no __tablename__")
        .otherwise("table not resolved: the ORM this class belongs to is not determined")
    )
    return joined.select(*found.columns, F.when(good, F.col("table")).alias("table"), reason.alias("table_reason"))


def access_edges(found: DataFrame) -> DataFrame:
    """One edge for each (file, enclosing function, model): the first by line; accesses at module level make none."""
    rows = found.where("enclosing is not null").groupBy("file", "enclosing", F.col("root").alias("model"))
    return rows.agg(F.min("line").alias("line"))


def table_edges(known: DataFrame) -> DataFrame:
    """An edge from each model with a declared table to it; models of one table share the node."""
    return known.where("table is not null").select(F.col("name").alias("model"), "table", "file", "line")


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee), at the first call site."""
    site = F.min(F.struct("file", "line", "seq")).alias("s")
    return calls.where("caller <> callee").groupBy("caller", "callee").agg(site).select("caller", "callee", F.col("s.file").alias("file"), F.col("s.line").alias("line"))


def reaching(calls: DataFrame, requesters: DataFrame) -> DataFrame:
    """Functions that reach a requester (name) through any number of calls (caller, callee), requesters included.

    Breadth first to the fixpoint: each round is one join with the frontier, whose rows are kept in the checkpoint folder.
    """
    found = frontier = kept(requesters.select("name").distinct())
    links = kept(calls.select("caller", "callee").distinct())
    while not frontier.isEmpty():
        back = links.join(frontier, F.col("callee") == F.col("name")).select(F.col("caller").alias("name")).distinct()
        frontier = kept(back.join(found, "name", "left_anti"))
        found = found.unionByName(frontier)
    return found
