"""Differences between two sets of parsed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dims


def diff(before: DataFrame, after: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys, change_type (added, removed, modified), changed (names of the differing columns), before and after structs.

    A full outer join on the keys; rows equal on both sides go. Keys are unique on each side (see
    last_by_key), and both sides are shuffled once, on the same keys.
    """
    b = before.select(*keys, F.struct(*compared).alias("before"))
    a = after.select(*keys, F.struct(*compared).alias("after"))
    both = b.join(a, keys, "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), c) for c in compared)))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.size(differs) > 0, "modified")
    out = both.withColumns({"change_type": kind, "changed": F.when(kind == "modified", differs).otherwise(F.expr("cast(array() as array<string>)"))})
    return out.where("change_type is not null").select(*keys, "change_type", "changed", "before", "after")


def last_by_key(symbols: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """A repeated key keeps its last occurrence."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return symbols.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def occurrence_names(symbols: DataFrame, order: str = "pos") -> DataFrame:
    """init#<hash>, and #n from the second equal body of a file on."""
    nth = F.row_number().over(Window.partitionBy("file", "body_hash").orderBy(order))
    base = F.concat(F.lit("init#"), F.col("body_hash"))
    return symbols.withColumn("key", F.when(nth == 1, base).otherwise(F.concat(base, F.lit("#"), nth)))


def change_summary(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Counters of added, removed and modified symbols by kind; diffs: by, symbol_kind, change_type."""
    return diffs.groupBy(*by).agg(*_change_counts().values())


def _change_counts() -> dict[str, Column]:
    kinds = (("function", "functions"), ("type", "types"), ("variable", "variables"), ("import", "imports"))
    return {f"{n}_{c}": F.count_if((F.col("symbol_kind") == k) & (F.col("change_type") == c)).alias(f"{n}_{c}") for k, n in kinds for c in ("added", "removed", "modified") if (k, c) != ("import", "modified")}


def signature(name: Column, params: Column, returns: Column, receiver: Column | None = None) -> Column:
    """Func (recv) name(a T, b U) (r, s)."""
    shown = F.array_join(F.transform(params, lambda p: F.trim(F.concat_ws(" ", p["name"], p["type"]))), ", ")
    results = F.when(F.size(returns) == 0, "").when(F.size(returns) == 1, F.concat(F.lit(" "), F.get(returns, 0))).otherwise(F.concat(F.lit(" ("), F.array_join(returns, ", "), F.lit(")")))
    method = F.lit("") if receiver is None else F.when(F.coalesce(receiver, F.lit("")) == "", "").otherwise(F.concat(F.lit("("), receiver, F.lit(") ")))
    return F.concat(F.lit("func "), method, name, F.lit("("), shown, F.lit(")"), results)


def field_table(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By field its old and new value, "-" where it is absent, and what became of it."""
    b, a = before.select(*keys, F.col(value).alias("old")), after.select(*keys, F.col(value).alias("new"))
    rows = b.join(a, keys, "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return rows.select(*keys, F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"), state.alias("state"))


def package_of(file: Column) -> Column:
    """the package of a file: its folder; main at the top; of an absolute path the folder's last name."""
    from tidemark.operators.paths import base_name, clean, dir_name

    path = clean(file)
    folder = dir_name(path)
    return F.when(folder == ".", "main").when(~F.startswith(path, F.lit("/")), folder).when(folder.isin("", "/"), "/").otherwise(base_name(folder))


def modified_functions(diffs: DataFrame) -> DataFrame:
    """added and modified functions with the package of their file and the receiver after, else before, "" if neither side has one. diffs: see diff(); without receivers in before and after, none are told."""
    out = diffs.where("change_type <> 'removed'").withColumn("package", package_of(F.col("file")))
    if "receiver" not in diffs.schema["after"].dataType.fieldNames():
        return out
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return out.withColumn("receiver", F.coalesce(given("after.receiver"), given("before.receiver"), F.lit("")))


def function_buckets(diffs: DataFrame) -> DataFrame:
    """Bucket, file, name, receiver, before, after (signatures), changes (array) of each function that differs. diffs: file, name, change_type, body_diff, before and after (null, or structs with sig and receiver).

    Receiver and changes are told of modified ones: the receiver after, else before, without blanks
    around it; the difference of the bodies if it is named, then signature_changed. A change that
    lacks the side that it is about has no row.
    """
    kind = F.col("change_type")
    there = F.when(kind == "added", F.col("after").isNotNull()).when(kind == "removed", F.col("before").isNotNull()).when(kind == "modified", F.col("before").isNotNull() | F.col("after").isNotNull())
    bucket = F.when(kind == "removed", "functions.deleted").otherwise(F.concat(F.lit("functions."), kind))
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    modified = kind == "modified"
    noted = F.array_compact(F.array(F.when(F.col("body_diff") != "", F.col("body_diff")), F.when(F.col("before.sig") != F.col("after.sig"), "signature_changed")))
    return diffs.where(F.coalesce(there, F.lit(False))).select(
        bucket.alias("bucket"), "file", "name", F.when(modified, F.coalesce(given("after.receiver"), given("before.receiver"), F.lit(""))).alias("receiver"),
        F.when(kind != "added", F.col("before.sig")).alias("before"), F.when(kind != "removed", F.col("after.sig")).alias("after"), F.when(modified, noted).otherwise(F.expr("cast(array() as array<string>)")).alias("changes"),
    )


def field_sides(fields: Column) -> tuple[Column, Column, Column]:
    """Fields before and after, as arrays of (name, type), and the labels name:change, of an array of (name, change, old, new)."""
    of = lambda kinds, side: F.transform(F.filter(fields, lambda x: x["change"].isin(*kinds)), lambda x: F.struct(x["name"].alias("name"), x[side].alias("type")))
    return of(("removed", "modified"), "old"), of(("added", "modified"), "new"), F.transform(fields, lambda x: F.concat(x["name"], F.lit(":"), x["change"]))


def batch(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """C20: one row for each pair; a pair without a result is an error row."""
    joined = pairs.join(results, "file", "left")
    return joined.withColumn("error", F.when(F.col("n_changes").isNull(), F.concat(F.lit("no result for "), F.col("file"))))


def batch_diff(pairs: DataFrame) -> DataFrame:
    """File, language, error and the counters of change_summary for each pair of file versions. pairs: before_path, before, after_path, after.

    A side whose path is null or empty is not there and has no symbols; one with a path and null
    content could not be read. The file's path (the one after, else the one before) decides the
    language. An error row has null counters: no parser for the extension, or the first side that
    could not be read. Both sides of all files are parsed in one pass, symbols and errors together,
    and shuffled once, by file and symbol. A symbol that a side repeats counts as its last one.
    Rows of one file are one pair; whichever of their sides comes last in order of content decides.
    """
    from tidemark.operators.paths import extension
    from tidemark.sources import parsers

    given = lambda c: F.when(F.col(c) != "", F.col(c))
    file = F.coalesce(given("after_path"), given("before_path"), F.lit(""))
    ext = F.lower(extension(file))
    typed = pairs.select(file.alias("file"), ext.alias("ext"), dims.mapped(ext, dims.SYMBOL_EXTENSIONS).alias("language"), given("before_path").alias("b"), "before", given("after_path").alias("a"), "after")
    side = lambda n, path, c: F.when(F.col(path).isNotNull(), F.struct(F.lit(n).alias("side"), F.col(c).alias("content")))
    sides = typed.where("language is not null").select("file", "language", F.explode(F.array_compact(F.array(side(0, "b", "before"), side(1, "a", "after")))).alias("s"))
    rows = parsers.symbols_or_errors(sides.select("file", "language", "s.side", "s.content"))
    version = F.struct("kind", "sig", "body_hash")
    last = lambda n: F.max_by(F.when((F.col("side") == n) & F.col("error").isNull(), version), F.when((F.col("side") == n) & F.col("error").isNull(), F.struct("start_line", "end_line", "sig")))
    wrong = F.min(F.when(F.col("error").isNotNull(), F.struct("side", "error")))
    each = rows.groupBy("file", "language", "symbol_kind", "name").agg(last(0).alias("before"), last(1).alias("after"), wrong.alias("wrong"))
    kind = F.when(F.col("symbol_kind").isNull(), None).when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    counted = each.withColumn("change_type", kind)
    changes = _change_counts()
    by_file = counted.groupBy("file").agg(F.min("wrong").alias("wrong"), *changes.values())
    first = F.concat(F.when(F.col("wrong.side") == 0, "parsing before file: ").otherwise("parsing after file: "), F.col("wrong.error"))
    files = typed.groupBy("file", "ext", "language").agg(F.lit(1).alias("__one"))
    out = files.join(by_file, "file", "left")
    error = F.when(F.col("language").isNull(), F.concat(F.lit("no extractor registered for extension: "), "ext")).when(F.col("wrong").isNotNull(), first)
    return out.select("file", "language", error.alias("error"), *(F.when(error.isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in changes))


def semantic_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """File, symbol_kind, name, change_type, changed of each symbol that differs between two sets of files (file, language, content); a file that one side lacks has no symbols there."""
    from tidemark.sources import parsers

    def parsed(files: DataFrame) -> DataFrame:
        found = parsers.symbols(files.select("file", "language", "content")).drop("language")
        return last_by_key(found, ["file", "symbol_kind", "name"], "start_line")

    return diff(parsed(before), parsed(after), ["file", "symbol_kind", "name"], ["kind", "sig", "body_hash"])


def fields_of(types: DataFrame) -> DataFrame:
    """File, type, field and its declared type of each type's list of fields (fields: array of "name: type")."""
    each = types.select("file", F.col("name").alias("type"), F.explode("fields").alias("f"))
    return each.select("file", "type", F.trim(F.substring_index("f", ":", 1)).alias("field"), F.trim(F.expr("substring(f, instr(f, ':') + 1)")).alias("declared"))


def type_fields_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """File, type and its changed fields as an array of (name, change, old, new), by name. A type's fields are few."""
    rows = field_table(fields_of(before), fields_of(after), ["file", "type", "field"], "declared").where("state <> 'unchanged'")
    item = F.struct(F.col("field").alias("name"), F.col("state").alias("change"), "old", "new")
    return rows.groupBy("file", "type").agg(F.array_sort(F.collect_list(item)).alias("fields"))


def what_changed(c: Column) -> Column:
    """The differing columns of a function in words."""
    words = {"sig": "signature", "kind": "kind", "body": "implementation", "body_hash": "implementation"}
    return F.array_join(F.array_distinct(F.transform(c, lambda x: F.coalesce(F.create_map(*(F.lit(w) for pair in words.items() for w in pair))[x], x))), ", ")
