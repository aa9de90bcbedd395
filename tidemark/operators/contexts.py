"""The documents that reviewers get, as ordered blocks of whole lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from tidemark.functions.reviewer_templates import TEMPLATES
from tidemark.functions.templates import Value, pieces
from tidemark.functions.text import sanitized
from tidemark.operators.calls import impact_level
from tidemark.operators.grouping import numbered_rows

_SIDE = "struct<Signature:string,LineStart:int,LineEnd:int>"
_FUNCTION = f"Package string, Name string, File string, Before {_SIDE}, After {_SIDE}, Changes array<string>"
_SYMBOL = "Package string, Name string, File string, LineStart int"
_FIELD_LIST = "struct<Fields:array<struct<Name:string,Type:string>>>"
_TYPE = f"Name string, Kind string, File string, Before {_FIELD_LIST}, After {_FIELD_LIST}"
_CALL = "array<struct<Function:string,File:string,Line:int>>"
_GRAPH = f"Function string, File string, Callers {_CALL}, Callees {_CALL}, TestCoverage array<struct<TestFunction:string,File:string,Line:int>>"
_FLOW = "ID string, Risk string, Notes string, Sanitized boolean, Source struct<Type:string,File:string,Line:int,Expression:string>, Sink struct<Type:string,File:string,Line:int,Expression:string>"
_NIL = "Variable string, File string, Line int, Checked boolean, CheckLine int, Expression string, Risk string, Notes string"
_IMPORT = "File string, Path string, Module string"
#: Columns of the tables that templates range over. Each may have a column ord, its order; else it is ordered by its columns.
TABLES: Mapping[str, str] = {
    "FocusAreas": "Title string, Description string",
    "Findings": "Severity string, Tool string, Rule string, File string, Line int, Message string",
    "ModifiedFunctions": _FUNCTION, "AddedFunctions": _SYMBOL, "ModifiedTypes": _TYPE,
    "HighRiskFlows": _FLOW, "MediumRiskFlows": _FLOW,
    "HighImpactFunctions": _GRAPH, "AllModifiedFunctionsGraph": _GRAPH, "UncoveredFunctions": _GRAPH, "CallerImpactedFunctions": _GRAPH, "OrphanFunctions": _GRAPH, "ZombieTests": _GRAPH,
    "NilSources": _NIL, "HighRiskNilSources": _NIL,
    "SignatureChanges": _FUNCTION, "TypeSurfaceChanges": _TYPE, "ImportsAdded": _IMPORT, "ImportsRemoved": _IMPORT, "RemovedImports": _IMPORT,
    "ErrorReturnsAdded": "Function string, File string, Line int, ErrorType string, Message string", "ErrorChecksRemoved": "Function string, File string, Line int",
    "DeletedFunctions": _SYMBOL, "DeletedTypes": "Type string",
}
#: Scalars of a document and what each says of its tables unless it is given: any of them filled, or their number of rows.
_ANY: Mapping[str, tuple[str, ...]] = {
    "HasSemanticChanges": ("ModifiedFunctions", "AddedFunctions", "ModifiedTypes"), "HasDataFlowAnalysis": ("HighRiskFlows", "MediumRiskFlows"), "HasCallGraph": ("AllModifiedFunctionsGraph", "HighImpactFunctions"), "HasNilSources": ("NilSources",),
    "HasConsequences": ("SignatureChanges", "TypeSurfaceChanges", "ImportsAdded", "ImportsRemoved", "ErrorReturnsAdded", "ErrorChecksRemoved", "CallerImpactedFunctions"),
    "HasDeadCodeSignals": ("DeletedFunctions", "DeletedTypes", "RemovedImports", "OrphanFunctions", "ZombieTests"),
}
_ONE = "FindingCount long, " + ", ".join(f"{n} boolean" for n in _ANY) + ", CallGraphPartialResults boolean, CallGraphTimeBudgetExceeded boolean, CallGraphWarnings array<string>"


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _texts(c: Column, kind: DataType) -> list[Column]:
    """The texts within a value, those of lists aside."""
    if isinstance(kind, StringType):
        return [c]
    return [t for f in kind.fields for t in _texts(c[f.name], f.dataType)] if isinstance(kind, StructType) else []


def _rebuilt(c: Column, kind: DataType, texts: Iterator[Column]) -> Column:
    """The value with its texts replaced, in their order; those of lists are sanitised in place."""
    if isinstance(kind, StringType):
        return next(texts)
    if isinstance(kind, StructType):
        return F.struct(*(_rebuilt(c[f.name], f.dataType, texts).alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        return F.transform(c, lambda x: _rebuilt(x, inner, iter([sanitized(t) for t in _texts(x, inner)])))
    return c


def _sanitized(rows: DataFrame, kind: StructType) -> DataFrame:
    """M21 on every text of a table: __row. The texts of a row are one list with one expression over it, as many expressions would outgrow compiled code."""
    whole = rows.select(F.struct(*(F.col(f.name) for f in kind.fields)).alias("__raw"))
    texts = _texts(F.col("__raw"), kind)
    listed = whole.withColumn("__texts", F.transform(F.array(*texts), sanitized))
    return listed.select(_rebuilt(F.col("__raw"), kind, iter([F.get("__texts", F.lit(i)) for i in range(len(texts))])).alias("__row"))


def _field_changes(t: Value) -> Value:
    """Name, before and after of each field that differs: those of the new shape in its order, then those that are gone. Of fields of one name the last counts."""
    before, after = t.part("Before").part("Fields"), t.part("After").part("Fields")
    named = lambda fields, name: F.filter(F.coalesce(fields.column, F.array().cast("array<struct<Name:string,Type:string>>")), lambda f: f["Name"].eqNullSafe(name))
    row = lambda name, a, z: F.struct(name.alias("Name"), a.alias("Before"), z.alias("After"))
    kept = F.transform(after.column, lambda f: F.when(F.size(named(before, f["Name"])) == 0, row(f["Name"], F.lit("-"), F.concat(f["Type"], F.lit(" (added)")))).when(~F.element_at(named(before, f["Name"]), -1)["Type"].eqNullSafe(f["Type"]), row(f["Name"], F.element_at(named(before, f["Name"]), -1)["Type"], f["Type"])))
    gone = F.transform(F.filter(before.column, lambda f: F.size(named(after, f["Name"])) == 0), lambda f: row(f["Name"], f["Type"], F.lit("(deleted)")))
    none = F.array().cast("array<struct<Name:string,Before:string,After:string>>")
    return Value(F.filter(F.concat(F.coalesce(kept, none), F.coalesce(gone, none)), lambda x: x.isNotNull()), _schema("x array<struct<Name:string,Before:string,After:string>>")["x"].dataType)


_FUNCTIONS = {
    "signatureChanged": lambda f: Value(~f.part("Before").part("Signature").column.eqNullSafe(f.part("After").part("Signature").column), _schema("x boolean")["x"].dataType),
    "fieldChanges": _field_changes,
    "riskLevel": lambda f: Value(impact_level(F.greatest(F.coalesce(F.size(f.part("Callers").column), F.lit(0)), F.lit(0))), StringType()),
}


def reviewer_document(spark: SparkSession, reviewer: str, tables: Mapping[str, DataFrame], partial: bool = False, time_exceeded: bool = False, warnings: tuple[str, ...] = (), **given: bool) -> DataFrame:
    """Blocks of a reviewer's document: part, ord, text. tables: by the names of TABLES, absent ones are empty; given: scalars, such as HasCallGraph=True for a call graph that holds nothing.

    Numbers of rows are the only thing that is looked at as a whole: they are read once, so what is
    shown and the text between the items are settled before the items are written, where they are.
    Items are sanitised as they are numbered, once, so no plan holds that work for each place.
    """
    template = TEMPLATES.get(reviewer)
    if template is None:
        raise ValueError(f"unknown reviewer: {reviewer}")
    unknown = (set(tables) - set(TABLES)) | (set(given) - set(_ANY))
    if unknown:
        raise ValueError(f"not known to templates: {', '.join(sorted(unknown))}")
    kinds = {n: _schema(d) for n, d in TABLES.items()}
    used = {n: tables[n] for n in tables if f".{n}" in template or any(n in v for k, v in _ANY.items() if f".{k}" in template)}
    numbered: dict[str, DataFrame] = {}
    for n, rows in used.items():
        order = ["ord"] if "ord" in rows.columns else []
        typed = rows.select(*order, *(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds[n].fields))
        numbered[n] = numbered_rows(typed, order or [f.name for f in kinds[n].fields], lambda d, kind=kinds[n]: _sanitized(d, kind))
    counts = None
    for n, rows in numbered.items():
        count = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n")
        counts = count if counts is None else counts.unionByName(count)
    held = {r["table"]: r["n"] for r in counts.collect()} if counts is not None else {}  # a row for each table
    one = spark.range(1).select(*(F.lit(held.get(n, 0)).cast("long").alias(f"rows_{n}") for n in TABLES))
    told = F.array(*(sanitized(F.lit(w)) for w in warnings)).cast("array<string>")
    scalars = {n: F.lit(given[n] if n in given else any(held.get(t, 0) for t in of)) for n, of in _ANY.items()}
    one = one.withColumns({**scalars, "FindingCount": F.col("rows_Findings"), "CallGraphPartialResults": F.lit(partial), "CallGraphTimeBudgetExceeded": F.lit(time_exceeded), "CallGraphWarnings": told})
    parts = pieces(template, _schema(_ONE), kinds, _FUNCTIONS)
    shown = one.select(*(p.guard.alias(f"shown_{k}") for k, p in enumerate(parts)), *(p.text.alias(f"text_{k}") for k, p in enumerate(parts) if p.table is None)).collect()[0]
    fixed = [(k, 0, shown[f"text_{k}"]) for k, p in enumerate(parts) if p.table is None and shown[f"shown_{k}"]]
    out = spark.createDataFrame(fixed, "part int, ord long, text string")
    for k, piece in enumerate(parts):
        if piece.table in numbered and shown[f"shown_{k}"]:
            text = piece.text(Value(F.col("__row"), kinds[piece.table]), Value(F.col("nth") - 1, _schema("x long")["x"].dataType))
            out = out.unionByName(numbered[piece.table].select(F.lit(k).alias("part"), F.col("nth").cast("long").alias("ord"), text.alias("text")))
    return out


def lines(blocks: DataFrame) -> DataFrame:
    """The lines of a document with their numbers: line, text."""
    rows = blocks.where("text <> ''").select("part", "ord", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("__at", "text"))
    return numbered_rows(rows, ["part", "ord", "__at"]).select(F.col("nth").alias("line"), "text")
