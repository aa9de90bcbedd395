"""Method sets and class hierarchy: what a type can do through what it embeds, and which interfaces it therefore implements.

Embeddings are followed level by level for all types at once. A name counts where it is found at
the least depth; found more than once there, it is ambiguous and counts nowhere. Implementing an
interface is a division: the type has all of the interface's methods. Types are held against an
interface through its rarest method alone, then their other methods are counted, so no pair of a
type and an interface is listed that does not share that method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import stored


def method_id(name: Column, package: Column) -> Column:
    """A name as methods are told apart: one that begins with a lower-case letter is its package's own."""
    first = F.substring(name, 1, 1)
    return F.when((F.upper(first) == first) & (F.lower(first) != first), name).otherwise(F.concat(package, F.lit("."), name))


def embedded_closure(embeds: DataFrame, roots: DataFrame) -> DataFrame:
    """type, at, depth, indirect, many: every type that a type reaches through embedded ones (itself at depth 0), at the least depth.

    embeds: type, target, pointer. many: it is reached in more than one way at that depth;
    indirect: a way leads through a pointer. A type met before is not entered again, so cycles end.
    """
    steps = embeds.select(F.col("type").alias("at"), "target", "pointer")
    level = stored(roots.select("type", F.col("type").alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("indirect"), F.lit(False).alias("many")).distinct(), "embedded")
    out, seen = level, level.select("type", "at")
    while True:
        ways = level.join(steps, "at").groupBy("type", F.col("target").alias("at")).agg((F.max("depth") + 1).alias("depth"), F.bool_or(F.col("indirect") | F.col("pointer")).alias("indirect"), (F.bool_or("many") | (F.count(F.lit(1)) > 1)).alias("many"))
        level = stored(ways.join(seen, ["type", "at"], "left_anti"), "embedded")
        if level.isEmpty():
            return out
        out, seen = out.unionByName(level), seen.unionByName(level.select("type", "at"))


def interface_methods(embeds: DataFrame, methods: DataFrame) -> DataFrame:
    """interface, method, signature: an interface's methods and those of the interfaces that it embeds. embeds: type, target; methods: type, method, signature."""
    reached = embedded_closure(embeds.select("type", "target", F.lit(False).alias("pointer")), methods.select("type").unionByName(embeds.select("type")).distinct())
    return reached.select(F.col("type").alias("interface"), F.col("at").alias("type")).join(methods.select("type", "method", "signature"), "type").select("interface", "method", "signature").distinct()


def method_sets(types: DataFrame, fields: DataFrame, methods: DataFrame, required: DataFrame) -> DataFrame:
    """type, method, signature, holder, file, of_value: what each concrete type has, itself or by promotion; of_value: the type has it, not only a pointer to it.

    types: type; fields: type, name, target (the type that an embedded field names, null for other
    fields), pointer; methods: type, method, signature, pointer (its receiver is one), file;
    required: interface_methods(), for interfaces that structs embed. A field hides a method of its name as
    another method does. Where a type declares a name twice, the name is ambiguous.
    """
    embedded = fields.where("target is not null")
    reached = embedded_closure(embedded.select("type", "target", "pointer"), types)
    own = methods.select(F.col("type").alias("at"), F.col("method").alias("name"), "signature", "pointer", "file", F.lit(True).alias("is_method"))
    abstract = required.select(F.col("interface").alias("at"), F.col("method").alias("name"), "signature", F.lit(False).alias("pointer"), F.lit(None).cast("string").alias("file"), F.lit(True).alias("is_method"))
    plain = fields.select(F.col("type").alias("at"), "name", F.lit(None).cast("string").alias("signature"), F.lit(False).alias("pointer"), F.lit(None).cast("string").alias("file"), F.lit(False).alias("is_method"))
    members = own.unionByName(abstract).unionByName(plain)
    found = reached.join(members, "at")
    counted = found.groupBy("type", "name", "depth").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(F.struct("is_method", "signature", F.col("at").alias("holder"), "file", "pointer", "indirect")).alias("m"))
    least = counted.groupBy("type", "name").agg(F.min(F.struct("depth", "n", "m")).alias("x")).where("x.n = 1 and x.m.is_method")
    return least.select("type", F.col("name").alias("method"), "x.m.signature", "x.m.holder", "x.m.file", (~F.col("x.m.pointer") | F.col("x.m.indirect")).alias("of_value"))


#: Types, or interfaces, of equal methods that one row holds: at most, or on the average.
_BLOCK = 1000
#: Rows of a result that a task makes, about.
_MADE = 1 << 24
#: Parts that the types of one method, or of one interface, are dealt out to.
_SPREAD = 64


def implements(sets: DataFrame, required: DataFrame) -> DataFrame:
    """type, interface, of_value: the type (of_value), or only a pointer to it, has every method of the interface with its signature. Interfaces without methods are left out: everything implements them and nothing is called through them.

    sets: method_sets(); required: interface_methods(). Interfaces of equal methods, and types of equal
    methods among those that any interface asks for, are held against each other as one, which the
    least of them stands for. Whether a kind of types has an interface's methods is asked where the
    two meet, on their lists, so what meets in vain is never written; only the result names each type
    and interface, and those rows go through no shuffle.
    """
    spark = sets.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = stored(required.select("method", "signature").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    wanted = required.join(ids, ["method", "signature"]).groupBy("interface").agg(F.array_sort(F.collect_set("id")).alias("methods"))
    alike = wanted.select("interface", "methods", (F.row_number().over(Window.partitionBy("methods").orderBy("interface")) - 1).alias("at"), F.min("interface").over(Window.partitionBy("methods")).alias("like"))
    alike = stored(alike, "interfaces")
    blocks = alike.groupBy("like", F.floor(F.col("at") / _BLOCK)).agg(F.collect_list("interface").alias("interfaces")).select("like", "interfaces")
    had = sets.join(ids, ["method", "signature"]).groupBy("type").agg(F.array_sort(F.collect_set("id")).alias("methods"), F.array_sort(F.collect_set(F.when(F.col("of_value"), F.col("id")))).alias("values"))
    had = stored(had, "had")
    kinds = stored(had.groupBy("methods", "values").agg(F.min("type").alias("kind"), F.count(F.lit(1)).alias("types")), "kinds")
    one = alike.where("at = 0").select("like", F.col("methods").alias("wanted"))
    frequency = kinds.select(F.explode("methods").alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("kinds"))
    ranked = one.select("like", "wanted", F.explode("wanted").alias("first")).join(frequency, "first", "left").fillna(0, ["kinds"])
    rarest = ranked.groupBy("like", "wanted").agg(F.min(F.struct("kinds", "first")).alias("r")).where("r.kinds > 0").select("like", "wanted", "r.first")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SPREAD - 1).cast("long")))
    asked = rarest.select("*", part.alias("part")).repartition(shuffled, "first", "part")
    meets = kinds.select("kind", "methods", "values", F.explode("methods").alias("first"), F.pmod(F.xxhash64("kind"), F.lit(_SPREAD)).alias("part")).join(rarest.select("first").distinct(), "first", "left_semi").repartition(shuffled, "first", "part")
    lacks = lambda of: F.size(F.array_except("wanted", of)) > 0
    found = stored(meets.join(asked, ["first", "part"]).where(~lacks("methods")).select("kind", "like", (~lacks("values")).alias("of_value")), "implemented")
    numbers = alike.groupBy("like").agg(F.count(F.lit(1)).alias("interfaces"))
    made = found.join(kinds.select("kind", "types"), "kind").groupBy("like").agg(F.sum("types").alias("types")).join(numbers, "like").agg(F.sum(F.col("types") * F.col("interfaces"))).first()[0] or 0
    tasks = max(shuffled, -(-made // _MADE))
    members = had.join(kinds, ["methods", "values"]).groupBy("kind", F.pmod(F.xxhash64("type"), F.ceil(F.col("types") / _BLOCK)).alias("block")).agg(F.collect_list("type").alias("types")).select("kind", "types")
    left = found.join(members, "kind").select("like", "types", "of_value", F.pmod(F.xxhash64("types"), F.lit(_SPREAD)).alias("part")).repartition(tasks, "like", "part")
    right = blocks.select("like", "interfaces", part.alias("part")).repartition(tasks, "like", "part")
    return left.join(right, ["like", "part"]).select(F.explode("types").alias("type"), "interfaces", "of_value").select("type", F.explode("interfaces").alias("interface"), "of_value")


def dispatch(sites: DataFrame, sets: DataFrame, implemented: DataFrame) -> DataFrame:
    """Caller, callee, is_virtual: each call of an interface's method with the method of every type that implements it. sites: caller, interface, method."""
    from tidemark.operators.calls import interface_edges

    methods = sets.select("type", "method", F.coalesce("file", F.lit("")).alias("file")).join(sites.select("method").distinct(), "method", "left_semi")
    return interface_edges(sites, implemented.select("type", "interface"), methods)
