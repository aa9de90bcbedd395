"""Data flow from untrusted sources to sensitive sinks, and nil risks, over source lines (file, line, text).

Go lines are judged without their comments (code_only), by the first match of a pattern in a line,
and flows follow the names that carry a value. Python and TypeScript lines are taken as they are,
every match counts, and flows are all pairs of a source and a later sink of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.functions import dims
from tidemark.functions.patterns import GO_NIL, GO_SANITIZER, LIBRARY, TYPESCRIPT_NULL, required_literal
from tidemark.operators.grouping import fold_groups

_VARIABLE = (r"(\w+)\s*(?:,\s*(?:err|ok|_))?\s*:?=", r"^\s*(\w+)\s*=")
_CALLED = r"(\w+(?:\.\w+)*)\s*\("
_NOT_NAMES = ("if", "for", "switch", "_")


def _holds(text: Column, pattern: str) -> Column:
    """Whether the text matches; a literal that every match holds is looked for first."""
    literal = required_literal(pattern)
    return text.contains(literal) & text.rlike(pattern) if literal else text.rlike(pattern)


def hit_list(text: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """The numbers of the patterns that a text matches. The library is unrolled into literal expressions, compiled once per task; a text is read once."""
    return F.array_compact(F.array(*(F.when(_holds(text, p), F.lit(i)) for i, (_, p, _) in enumerate(patterns))))


def likely(text: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """Whether a text may match any of the patterns: one expression over the literals that their matches hold, as one test for each would outgrow compiled code."""
    literals = dict.fromkeys(required_literal(p) for _, p, _ in patterns)
    kept = [any_of([x for x in literals if x])] if any(literals) else []
    kept += dict.fromkeys(f"(?:{p})" for _, p, _ in patterns if not required_literal(p))
    return text.rlike("|".join(kept)) if kept else F.lit(False)


def any_of(literals: Sequence[str]) -> str:
    """An expression for any of the texts, which are not empty: a place is left at once if none begins with its character, else only those that do are tried."""
    by_first: dict[str, list[str]] = {}
    for x in literals:
        by_first.setdefault(x[0], []).append(x[1:])
    each = (f"{re.escape(c)}(?:{'|'.join(map(re.escape, rest))})" for c, rest in by_first.items())
    return f"(?=[{''.join(map(re.escape, by_first))}])(?:{'|'.join(each)})"


def match_column(text: Column, pattern: str) -> Column:
    """The 1-based byte where the first match begins, 0 if there is none."""
    before = F.regexp_instr(text, F.lit(pattern))
    return F.when(before == 0, 0).otherwise(F.octet_length(F.substring(text, F.lit(1), before - 1)) + 1)


def hits(lines: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """J08, Go: one row for each pattern that a line matches: the line with ord, type, pattern (its description) and column."""
    told = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in patterns)), F.col("ord") + 1)
    column = F
    for i, (_, p, _) in enumerate(patterns):
        column = column.when(F.col("ord") == i, match_column(F.col("text"), p))
    found = lines.where(likely(F.col("text"), patterns)).select("*", F.explode(hit_list(F.col("text"), patterns)).alias("ord"))
    return found.select(*lines.columns, "ord", told(0).alias("type"), told(2).alias("pattern"), column.alias("column"))


def named_in(text: str, at: int) -> str:
    """The name that a match at a place goes by: what it is assigned to, else its property, else its first word."""
    before = text[:at].rstrip()
    for p in _ASSIGNED_TO:
        if m := p.search(before):
            return m[1]
    m = _PROPERTY.match(text, at) or _WORD.match(text, at)
    return m[1] if m else "<unknown>"


_ASSIGNED_TO = tuple(map(re.compile, (r"(\w+)\s*=\s*$", r"(?:const|let|var)\s+(\w+)\s*=\s*$", r"(\w+)\s*:=\s*$", r"(\w+)\s*:\s*\w+\s*=\s*$")))
_PROPERTY, _WORD = re.compile(r"\w+\.(\w+)"), re.compile(r"(\w+)")


def every_hit(lines: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """J08, Python and TypeScript: one row for each match: the line with ord, nth (match of the pattern in the line), type, pattern, column, variable.

    The engine has no function for the places of all matches, so lines that hold one of the
    patterns' literals go through Python, in Arrow batches, without a shuffle.
    """
    literals = [required_literal(p) for _, p, _ in patterns]
    added = [StructField(n, StringType() if n in ("type", "pattern", "variable") else IntegerType()) for n in ("ord", "nth", "type", "pattern", "column", "variable")]
    kind = StructType([*lines.schema.fields, *added])
    where, sources = lines.columns.index("text"), [p for _, p, _ in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, target = [re.compile(p) for p in sources], to_arrow_schema(kind)

        @lru_cache(1 << 14)  # code repeats itself, so a task keeps what it found for the last texts
        def matched(text: str) -> list[tuple]:
            return [
                (k, n, patterns[k][0], patterns[k][2], m.start() + 1, named_in(text, m.start()))
                for k, p in enumerate(compiled) if not literals[k] or literals[k] in text for n, m in enumerate(p.finditer(text))
            ]

        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(where).to_pylist()):
                if text and (of := matched(text)):
                    rows += [i] * len(of)
                    found += of
            if rows:
                kept = b.take(pa.array(rows, pa.int64()))
                new = [pa.array(c, target.field(j + b.num_columns).type) for j, c in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([*(c.cast(target.field(j).type) for j, c in enumerate(kept.columns)), *new], schema=target)

    return lines.where(likely(F.col("text"), patterns)).mapInArrow(run, kind)


def stored_hits(lines: DataFrame, libraries: Mapping[str, Sequence[tuple[str, str, str]]]) -> dict[str, DataFrame]:
    """every_hit of several libraries, by their names: found in one pass over the lines and written once, as each is read more than once."""
    from tidemark.sources.store import stored

    kept = stored(every_hit(lines, [p for ps in libraries.values() for p in ps]), "hits")
    out, low = {}, 0
    for name, ps in libraries.items():
        out[name] = kept.where(F.col("ord").between(low, low + len(ps) - 1)).withColumn("ord", F.col("ord") - low)
        low += len(ps)
    return out


def assigned_variable(text: Column) -> Column:
    """The name before the first assignment, "" if there is none."""
    names = [F.regexp_extract(text, p, 1) for p in _VARIABLE]
    usable = [F.when((n != "") & ~n.isin(*_NOT_NAMES), n) for n in names]
    return F.coalesce(*usable, F.lit(""))


def called_function(text: Column) -> Column:
    """M06."""
    return F.regexp_extract(text, _CALLED, 1)


def compact(text: Column) -> Column:
    """Without spaces and tabs."""
    return F.translate(text, " \t", "")


def identifier_in(text: Column, name: str) -> Column:
    """The name as a whole identifier, or one of its derivatives."""
    n = re.escape(name)
    return text.rlike(rf"(?<![A-Za-z0-9_]){n}(?![A-Za-z0-9_])|{n}[.\[]|[*&]{n}|{n}(?:Str|String|Bytes)")


def flow_id(kind: str = "tracked") -> Column:
    """Tracked flows by places, types and the patterns' descriptions; positional ones by places and types."""
    place = lambda s: F.concat_ws(":", f"{s}_file", F.col(f"{s}_line").cast("string"), f"{s}_type")
    if kind == "tracked":
        return F.concat(F.lit("flow_"), F.substring(F.sha2(F.concat_ws("|", place("source"), place("sink"), "source_pattern", "sink_pattern"), 256), 1, 16))
    return F.substring(F.sha2(F.concat_ws(":", place("source"), place("sink")), 256), 1, 16)


def risk(source: Column, sink: Column, sanitized: Column, ssrf: bool = False) -> Column:
    """F24, and F25 with the ssrf sink."""
    user = source.isin(*dims.USER_SOURCES)
    deep = sink.isin("command_exec", "database")
    shown = sink.isin("http_response", "template", "redirect", *(("ssrf",) if ssrf else ()))
    return (
        F.when(sanitized, "info").when(user & deep, "critical").when(user & shown, "high").when(source.isin("env_var", "file_read") & deep, "medium")
        .when(sink == "file_write", "medium").when(sink == "logging", "low").otherwise("info")
    )


def recommendation(sink: Column) -> Column:
    """F30."""
    return dims.mapped(sink, dims.RECOMMENDATIONS, dims.OTHER_RECOMMENDATION)


_PAIRED = ("line", "ord", "nth", "type", "pattern", "seen")


def _paired(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    side = lambda d, r: d.select(F.col("file").alias(f"{r}_file"), *(F.col(c).alias(f"{r}_{c}") for c in _PAIRED if c in d.columns))
    return side(sources, "source").join(side(sinks, "sink"), (F.col("source_file") == F.col("sink_file")) & (F.col("source_line") <= F.col("sink_line")))


def positional_flows(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Every source with every sink of its file on the same or a later line. An equi-join on the file with the lines as a residual condition."""
    return _paired(sources, sinks)


def first_of_line(found: DataFrame) -> DataFrame:
    """The first match of a type in a line, by pattern, then place: all that flows are told apart by."""
    rest = [c for c in found.columns if c not in ("file", "line", "type", "ord", "nth")]
    best = found.groupBy("file", "line", "type").agg(F.min_by(F.struct("ord", "nth", *rest), F.struct("ord", "nth")).alias("b"))
    return best.select("file", "line", "type", "b.*")


#: Matches that a task sorts, about.
_TASK_ROWS = 1 << 19


def first_flows(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """The first flow of each id, with the id. An id is made of places and types, so the first matches are picked before they are paired.

    Each side is dealt out by file and sorted once; that order serves both the first matches and
    the pairs. There are more tasks for more matches, so what one sorts does not grow with the
    input. Both sides are counted before: they should be read from stored tables, as stored_hits
    gives them.
    """
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(sources.count(), sinks.count()) // _TASK_ROWS))
    side = lambda d: first_of_line(d.select("file", *(c for c in _PAIRED if c in d.columns)).repartition(tasks, "file").sortWithinPartitions("file", "line", "type"))
    return _paired(side(sources), side(sinks)).withColumn("id", flow_id("positional"))


def sanitizing_counts(lines: DataFrame, sanitizers: Mapping[str, Sequence[str]]) -> DataFrame:
    """The lines with seen: by sink type of sanitizers, how many lines of the file up to this one sanitize for it, and whether it does itself."""
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    text, every = F.col("text"), [p for ps in sanitizers.values() for p in ps]
    # most lines match none, which one test tells
    flags = [F.when(F.col("__any"), text.rlike("(?i)(?:" + "|".join(ps) + ")").cast("int")).otherwise(F.when(text.isNotNull(), 0)) for ps in sanitizers.values()]
    marked = lines.withColumn("__any", text.rlike("(?i)(?:" + "|".join(every) + ")")).withColumns({f"__f{i}": f for i, f in enumerate(flags)})
    seen = F.array(*(F.struct(F.sum(f"__f{i}").over(upto).alias("upto"), F.col(f"__f{i}").alias("here")) for i in range(len(flags))))
    return marked.withColumn("seen", seen).select(*lines.columns, "seen")


def window_sanitized(flows: DataFrame, sanitizers: Mapping[str, Sequence[str]]) -> DataFrame:
    """J11, positional: whether any line from source to sink sanitizes for the sink's type.

    Neither a range join nor a join back to the lines: both ends carry the running counts of
    sanitizing_counts, and the window has such a line if the count at the sink exceeds the count
    before the source.
    """
    hit = F.lit(False)
    for i, t in enumerate(sanitizers):
        hit = F.when(F.col("sink_type") == t, F.col("sink_seen")[i]["upto"] - F.col("source_seen")[i]["upto"] + F.col("source_seen")[i]["here"] > 0).otherwise(hit)
    return flows.withColumn("sanitized", hit).drop("source_seen", "sink_seen")


#: What is counted.
COUNTERS = ("total_sources", "total_sinks", "total_flows", "unsanitized_flows", "critical_flows", "high_risk_flows", "nil_risks", "unchecked_nil_risks")


def statistics(sources: DataFrame, sinks: DataFrame, flows: DataFrame, nils: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Eight counters, by the given columns. Each input is counted where it is; only counts are shuffled. nils: with is_checked."""
    when = {
        "total_sources": (sources, F.lit(True)), "total_sinks": (sinks, F.lit(True)),
        "total_flows": (flows, F.lit(True)), "unsanitized_flows": (flows, ~F.col("sanitized")), "critical_flows": (flows, F.col("risk") == "critical"), "high_risk_flows": (flows, F.col("risk") == "high"),
        "nil_risks": (nils, F.lit(True)), "unchecked_nil_risks": (nils, ~F.col("is_checked")),
    }
    parts = None
    for rows in (sources, sinks, flows, nils):
        counts = rows.groupBy(*by).agg(*((F.count_if(when[c][1]) if when[c][0] is rows else F.lit(0).cast("long")).alias(c) for c in COUNTERS))
        parts = counts if parts is None else parts.unionByName(counts)
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def by_risk(flows: DataFrame) -> DataFrame:
    """The worst first, then by place and id."""
    return flows.orderBy(dims.mapped(F.col("risk"), dims.RISK_ORDER, 9), "source_file", "source_line", "sink_line", "id")


_CUT, _WHOLE = r"//.*|/\*.*?\*/|/\*.*", r"//.*|/\*.*?\*/"


def code_only(lines: DataFrame) -> DataFrame:
    """Each line's text outside comments; a block comment may go on over lines. Rows of a file lie together, by line.

    Whether a line begins inside a block comment follows from the lines before: most leave that as
    it is, some decide it, and a few turn it round. So it is what the last deciding line says,
    turned round as often as such lines came since: two running values over one sort.
    """
    opens = lambda t: F.when(t.contains("/*"), F.contains(F.regexp_replace(t, _WHOLE, " "), F.lit("/*"))).otherwise(False)
    text = F.coalesce(F.col("text"), F.lit(""))
    closes = F.instr(text, "*/")
    tail = F.substring(text, closes + 2, F.length(text))
    after = lines.select(*(F.col(c) for c in lines.columns if c != "text"), text.alias("text"), opens(text).alias("__out"), ((closes == 0) | opens(tail)).alias("__in"))
    w = Window.partitionBy("file").orderBy("line")
    turns = F.sum((F.col("__out") & ~F.col("__in")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = after.withColumn("__turns", turns).withColumn("__says", F.when(F.col("__out") == F.col("__in"), F.struct(F.col("__out").alias("inside"), F.col("__turns").alias("turns"))))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last, so_far = F.last("__says", ignorenulls=True).over(before), F.coalesce(F.last("__turns").over(before), F.lit(0))
    started = counted.withColumns({"__last": last, "__so_far": so_far})
    odd = (F.col("__so_far") - F.coalesce(F.col("__last.turns"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("__last.inside"), F.lit(False)) != odd
    rest = F.when(inside, F.when(closes == 0, "").otherwise(tail)).otherwise(F.col("text"))
    kept = started.withColumn("text", rest)
    marked = F.col("text").contains("//") | F.col("text").contains("/*")  # the expression is for the few lines that hold a comment
    return kept.withColumn("text", F.when(marked, F.regexp_replace("text", _CUT, "")).otherwise(F.col("text"))).select(*lines.columns)


_ASSIGN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*(.+)$")
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)")
_FUNC = re.compile(r"\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)")
_TOKEN = re.compile(r"[A-Za-z0-9_]+")


@lru_cache(1 << 14)
def _mentions(text: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """A text's identifiers, and those parts of them whose ends, and whose beginnings, may be names. Code repeats itself, so a task keeps what it found for the last texts, as below."""
    whole: dict[str, None] = {}
    ending: dict[str, None] = {}
    beginning: dict[str, None] = {}
    for m in _TOKEN.finditer(text):
        token, lo, hi = m[0], m.start(), m.end()
        whole[token] = None
        if hi < len(text) and text[hi] in ".[":
            ending[token] = None
        if lo and text[lo - 1] in "*&":
            beginning[token] = None
        for tail in ("Str", "Bytes"):
            at = token.find(tail)
            while at >= 0:
                ending[token[:at]] = None
                at = token.find(tail, at + 1)
    return tuple(whole), tuple(ending), tuple(beginning)


@lru_cache(1 << 14)
def _searched(pattern: re.Pattern, text: str) -> re.Match | None:
    return pattern.search(text)


@lru_cache(1 << 14)
def _line_parts(text: str) -> tuple[re.Match | None, re.Match | None, tuple[tuple[str, list[str]], ...]]:
    """What a line may do to tracked names: it declares a function, assigns, or calls functions with arguments."""
    m = _ASSIGN.match(text)
    return _FUNC.match(text), m, () if m else tuple((c[1], split_arguments(c[2])) for c in _CALL.finditer(text))


class Names:
    """The names of a file by number, and which of them a text mentions, itself or as a derivative, as bits of one integer.

    A name is mentioned as a whole identifier, before "." or "[", after "*" or "&", or before Str or
    Bytes. So only the ends of a text's identifiers are looked up, in lengths that names have: the
    work follows the text, not the number of names.
    """

    def __init__(self, names: set[str]) -> None:
        self.bit = {n: 1 << i for i, n in enumerate(sorted(names))}
        self.lengths = sorted({len(n) for n in names})

    def __call__(self, text: str) -> int:
        out, bit = 0, self.bit.get
        whole, ending, beginning = _mentions(text)
        for token in whole:
            out |= bit(token, 0)
        for token in ending:
            for n in self.lengths:
                if n > len(token):
                    break
                out |= bit(token[len(token) - n :], 0)
        for token in beginning:
            for n in self.lengths:
                if n >= len(token):
                    break
                out |= bit(token[:n], 0)
        return out

    def of(self, bits: int) -> list[str]:
        return [n for n, b in self.bit.items() if bits & b]


def split_arguments(text: str) -> list[str]:
    """At commas outside brackets; a closing bracket without an opening one counts for nothing."""
    if not text.strip():
        return []
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def parameter_names(text: str) -> list[str]:
    """The first word of each parameter that has a type beside it."""
    return [p.split()[0] for p in text.split(",") if len(p.split()) > 1]


class Steps:
    """What each line does to the set of tracked names."""

    def __init__(self, texts: Sequence[str], born: set[str]) -> None:
        parts = [_line_parts(t.strip()) for t in texts]
        params = {m[1]: parameter_names(m[2]) for m, _, _ in parts if m}
        self.names = names = Names(born | {m[1] for _, m, _ in parts if m} | {p for ps in params.values() for p in ps})
        self.steps: list[tuple[int, int] | list[tuple[int, int]] | None] = []
        for _, m, calls in parts:
            if m:
                self.steps.append(None if m[1] == "_" else (names.bit[m[1]], names(m[2])))
                continue
            given = [(names.bit[p], names(a)) for called, arguments in calls if called in params for p, a in zip(params[called], arguments, strict=False)]
            self.steps.append(given or None)

    def after(self, i: int, own: int, tracked: int) -> int:
        """The tracked names after line i; own, the name of the source, stays."""
        step = self.steps[i]
        if step is None:
            return tracked
        if isinstance(step, tuple):
            name, read = step
            return tracked | name if read & tracked else tracked if name == own else tracked & ~name
        for name, read in step:
            if read & tracked:
                tracked |= name
        return tracked


_NAME_OF = [re.compile(p, re.A) for p in _VARIABLE]


@lru_cache(1 << 14)
def variable_of(text: str) -> str:
    for p in _NAME_OF:
        if (m := p.search(text)) and m[1] not in _NOT_NAMES:
            return m[1]
    return ""


def file_flows(texts: Sequence[str], sources: Mapping[int, list], sinks: Mapping[int, list], clean: re.Pattern, called: re.Pattern) -> Iterator[tuple]:
    """(source line, source, name, sink line, sink, sanitized) of one file, lines from 0, in one pass over its lines.

    Sources that track equal names under an equal name go on as one from there, so a line is
    weighed once for each set of names alive, not once for each source. Which sanitizing lines
    count depends on the names tracked at the sink; for each name the last sanitizing line that
    mentions it is kept, in all, with a variable, and by variable.
    """
    last = max(sinks, default=-1)
    born = {i: variable_of(texts[i]) for i in sources if i < last}
    if not any(born.values()):
        return
    steps = Steps(texts, {n for n in born.values() if n} | {v for t in texts[: last + 1] if _searched(clean, t) and (v := variable_of(t))})
    names = steps.names
    alive: dict[tuple[int, int], list[tuple[int, str, list]]] = {}
    cleaned: dict[int, tuple[int, int, dict[int, int]]] = {}  # by name: last line, last one with a variable, last one by variable
    for i in range(last + 1):
        if i in sinks and alive:
            text = texts[i]
            read, itself = names(text), bool(_searched(clean, text))
            decoder = (m := _searched(called, text)) and m[1] in ("json.Unmarshal", "json.NewDecoder")
            for (_, tracked), members in alive.items():
                if not read & tracked:
                    continue
                any_line = named = given = -1
                for b, (x, y, by) in cleaned.items():
                    if b & tracked:
                        any_line, named = max(any_line, x), max(named, y)
                        given = max(given, max((at for v, at in by.items() if v & read), default=-1))
                for at, name, found in members:
                    safe = any_line >= at and (itself or named < at or given >= at)
                    for s in found:
                        if not (decoder and s[1] == "json_decode"):
                            for k in sinks[i]:
                                yield at, s, name, i, k, safe
        if i in sources and born.get(i):
            own = names.bit[born[i]]
            alive.setdefault((own, own), []).append((i, born[i], sources[i]))
        if _searched(clean, texts[i]):
            v = names.bit.get(variable_of(texts[i]), 0)
            for n in names.of(names(texts[i])):
                b = names.bit[n]
                _, y, by = cleaned.get(b, (-1, -1, {}))
                if v:
                    by[v] = i
                cleaned[b] = i, i if v else y, by
        if steps.steps[i] is not None and alive:
            moved: dict[tuple[int, int], list] = {}
            for (own, tracked), members in alive.items():
                key = own, steps.after(i, own, tracked)
                other = moved.get(key)
                if other is None:
                    moved[key] = members
                else:
                    if len(other) < len(members):
                        other, members = members, other
                    other.extend(members)
                    moved[key] = other
            alive = moved


def tracked_flows(lines: DataFrame, sources: Sequence[tuple[str, str, str]], sinks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """J09 with J11 and W06: flows whose sink line mentions a name that carries the source's value.

    Order-dependent state makes this a fold over a file's lines, without comments: files are folded
    one at a time, each bounded at the source. Matches are found before that, in the engine, and the
    lines are shuffled once, by file.
    """
    text = F.col("text")
    marked = code_only(lines.select("file", "line", "text")).select("file", "line", "text", hit_list(text, sources).alias("sources"), hit_list(text, sinks).alias("sinks"))
    clean, called = re.compile(GO_SANITIZER), re.compile(_CALLED, re.A)
    told = lambda library, found: [(i, library[i][0], library[i][2]) for i in found]

    def fold(file: str, group: list[tuple]):
        at = [r[1] for r in group]
        starts = {i: told(sources, r[3]) for i, r in enumerate(group) if r[3]}
        ends = {i: told(sinks, r[4]) for i, r in enumerate(group) if r[4]}
        for i, s, name, j, k, safe in file_flows([r[2] for r in group], starts, ends, clean, called):
            yield file, file, at[i], *s, name, at[j], *k, safe

    schema = "source_file string, sink_file string, source_line int, source_ord int, source_type string, source_pattern string, variable string, sink_line int, sink_ord int, sink_type string, sink_pattern string, sanitized boolean"
    return fold_groups(marked, "file", ["line"], fold, schema, dealt=True)


def taint_sets(lines: DataFrame, sources: Sequence[tuple[str, str, str]]) -> DataFrame:
    """W06 alone: by source line and name the names that carry its value after the last line of the file."""
    marked = code_only(lines.select("file", "line", "text"))
    marked = marked.withColumn("name", F.when(F.size(hit_list(F.col("text"), sources)) > 0, assigned_variable(F.col("text"))).otherwise(""))

    def fold(file: str, group: list[tuple]):
        steps = Steps([r[2] for r in group], {r[3] for r in group if r[3]})
        alive: dict[tuple[int, int], list[tuple]] = {}
        for i, (_, line, _, name) in enumerate(group):
            if name:
                own = steps.names.bit[name]
                alive.setdefault((own, own), []).append((line, name))
            if steps.steps[i] is not None:
                moved: dict[tuple[int, int], list[tuple]] = {}
                for (own, tracked), members in alive.items():
                    moved.setdefault((own, steps.after(i, own, tracked)), []).extend(members)
                alive = moved
        for (_, tracked), members in alive.items():
            text = ",".join(sorted(steps.names.of(tracked)))
            for line, name in members:
                yield file, line, name, text

    return fold_groups(marked, "file", ["line"], fold, "file string, line int, name string, names string", dealt=True)


def nil_sources(lines: DataFrame) -> DataFrame:
    """Nil candidates by file and variable; of several the last line, there the last pattern (D5). lines: without comments."""
    found = [F.when(F.regexp_extract("text", p, 1) != "", F.struct(F.lit(i).alias("ord"), F.regexp_extract("text", p, 1).alias("variable"))) for i, p in enumerate(GO_NIL)]
    rows = lines.select("file", "line", "text", F.explode(F.array_compact(F.array(*found))).alias("n")).select("file", "line", "text", "n.*").where("variable <> '_'")
    last = Window.partitionBy("file", "variable").orderBy(F.col("line").desc(), F.col("ord").desc())
    return rows.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def nil_origin(text: Column) -> Column:
    """ordered tests."""
    has = text.contains
    return (
        F.when(has("["), "map_lookup").when(has(".("), "type_assertion").when(has("Query"), "database_query").when(has("Unmarshal"), "json_unmarshal")
        .when(has("Find") | has("Get") | has("Lookup"), "lookup_operation").when(has("Value("), "context_value").when(has("<-"), "channel_receive").otherwise("unknown")
    )


_NIL_EXPRESSIONS = [(re.compile(p, re.A), required_literal(p)) for p in GO_NIL]


@lru_cache(1 << 14)
def _nil_names(text: str) -> tuple[str, ...]:
    """The names that a line may make nil. Code repeats itself, so a task keeps what it found for the last texts."""
    return tuple(m[1] for p, literal in _NIL_EXPRESSIONS if (not literal or literal in text) and (m := p.search(text)) and m[1] not in ("", "_"))


def file_nils(texts: Sequence[str]) -> Iterator[tuple[str, int, str, int | None, int | None]]:
    """(variable, line from 0, text, checking line, last line of use before it) of one file's nil candidates, in one pass."""
    born: dict[str, int] = {}
    for i, t in enumerate(texts):
        for n in _nil_names(t):
            born[n] = i
    if not born:
        return
    names = Names(set(born))
    check: dict[str, int] = {}
    use: dict[str, int] = {}
    for i, t in enumerate(texts):
        if "nil" not in t and "." not in t and "[" not in t and "*" not in t:
            continue
        c = t.replace(" ", "").replace("\t", "")
        tested = {n for n in _tested(c, names) if born[n] < i}
        for n in tested:
            check.setdefault(n, i)
        for n in _used(c, names):
            if born[n] < i and n not in check:
                use[n] = i
    for n, i in born.items():
        yield n, i, texts[i], check.get(n), use.get(n)


def _tested(c: str, names: Names) -> Iterator[str]:
    """Names that a line without blanks compares with nil: "if" and the comparison, or the comparison and a brace."""
    at = c.find("nil")
    while at >= 0:
        if c[at - 2 : at] in ("!=", "==") and at >= 2:
            end = at - 2
            for n in names.lengths:
                if n > end:
                    break
                if (name := c[end - n : end]) in names.bit and (c[max(0, end - n - 2) : end - n] == "if" or c.startswith("{", at + 3)):
                    yield name
        if c[at - 2 : at] == "if" and at >= 2 and c[at + 3 : at + 5] in ("!=", "=="):
            for n in names.lengths:
                if (name := c[at + 5 : at + 5 + n]) in names.bit and len(name) == n:
                    yield name
        at = c.find("nil", at + 1)


def _used(c: str, names: Names) -> Iterator[str]:
    for m in re.finditer(r"[A-Za-z0-9_](?=[.\[])", c):
        for n in names.lengths:
            if n > m.end():
                break
            if (name := c[m.end() - n : m.end()]) in names.bit:
                yield name
    at = c.find("*")
    while at >= 0:
        for n in names.lengths:
            if (name := c[at + 1 : at + 1 + n]) in names.bit and len(name) == n:
                yield name
        at = c.find("*", at + 1)


def nil_risks(lines: DataFrame) -> DataFrame:
    """J12/W04, Go: nil candidates that no later line checks; the last later use makes the risk high, none medium. One shuffle, one pass over each file."""

    def fold(file: str, group: list[tuple]):
        for name, i, text, check, use in file_nils([r[2] for r in group]):
            if check is None and ", ok" not in text and ", _" not in text:
                yield file, name, group[i][1], text, None if use is None else group[use][1]

    found = fold_groups(code_only(lines.select("file", "line", "text")), "file", ["line"], fold, "file string, variable string, line int, text string, usage_line int", dealt=True)
    return found.select("file", "variable", "line", nil_origin(F.col("text")).alias("origin"), "usage_line", F.when(F.col("usage_line").isNull(), "medium").otherwise("high").alias("risk"), F.lit(False).alias("is_checked"))


_VALUE = r"\s*(?:!==?|===?)\s*(?:null|undefined)"
_EVENTS = {"check": (rf"\b(\w+)\b(?={_VALUE})", r"(?:null|undefined)\s*(?:!==?|===?)\s*\b(\w+)\b"), "use": (r"\b(\w+)\b(?=\s*[.\[])",)}


def _null_patterns() -> list[tuple[str, str, str]]:
    return [(origin, p, d) for p, d, origin in TYPESCRIPT_NULL]


def null_risks(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """J12/W04, TypeScript: every match of an expression that may be null, with the first later line that checks its name or uses it.

    What lines check and use are rows by file and name; the first one after a match is a running
    minimum from the end, so no pair of lines is formed. found: the matches, if they are known.
    """
    found = (every_hit(lines, _null_patterns()) if found is None else found).select("file", "line", "variable", "ord", "nth", F.col("type").alias("origin"), "pattern", "column")
    has = F.col("text").contains
    may = {"check": (has("null") | has("undefined")) & (has("==") | has("!=")), "use": has(".") | has("[")}  # what every match holds
    all_of = lambda kind: F.when(may[kind], F.array_distinct(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in _EVENTS[kind])))).otherwise(F.array().cast("array<string>"))
    labelled = lambda kind: F.transform(all_of(kind), lambda x: F.struct(x.alias("variable"), F.lit(kind).alias("kind")))
    both = F.flatten(F.array(*map(labelled, _EVENTS)))
    events = lines.select("file", "line", F.explode(both).alias("e")).select("file", "line", "e.*")
    rows = found.withColumn("kind", F.lit("hit")).unionByName(events, allowMissingColumns=True)
    later = Window.partitionBy("file", "variable").orderBy(F.col("line").desc()).rangeBetween(Window.unboundedPreceding, -1)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("line"))).over(later)
    met = rows.withColumns({"check": first("check"), "use": first("use")}).where("kind = 'hit'")
    named = F.col("variable") != "<unknown>"
    checked = named & F.col("check").isNotNull() & (F.col("use").isNull() | (F.col("check") <= F.col("use")))
    used = named & F.col("use").isNotNull() & ~checked
    return met.select(
        "file", "line", "variable", "ord", "nth", "origin", "pattern", "column", checked.alias("is_checked"), F.when(checked, F.col("check")).otherwise(0).alias("check_line"), F.when(used, F.col("use")).otherwise(0).alias("usage_line"),
        F.when(checked, "low").when(used, "high").otherwise("medium").alias("risk"),
    )


def analysis(lines: DataFrame, language: str, sanitizers: Mapping[str, Sequence[str]] | None = None, reused: bool = False) -> dict[str, DataFrame]:
    """Sources, sinks, flows (with risk), nil_sources and statistics of one language's files. reused: the parts are read more than once, so what others rest on is written."""
    from tidemark.sources.store import stored

    keep = stored if reused else lambda d, _: d
    sources, sinks = LIBRARY[language]
    if language == "go":
        files = lines.where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go"))
        code = code_only(files)
        found = {"sources": hits(code, sources), "sinks": hits(code, sinks)}
        flows = tracked_flows(files, sources, sinks)
        flows = keep(flows.withColumns({"id": flow_id(), "risk": risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized"))}), "flows")
        nils = keep(nil_risks(files), "nils")
    else:
        libraries = {"sources": sources, "sinks": sinks} | ({"nulls": _null_patterns()} if language == "typescript" else {})
        found = stored_hits(sanitizing_counts(lines, sanitizers), libraries)
        nulls = found.pop("nulls", None)
        flows = window_sanitized(first_flows(found["sources"], found["sinks"]), sanitizers)
        flows = keep(flows.withColumn("risk", risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized"), True)), "flows")
        nils = keep(null_risks(lines, nulls), "nils") if language == "typescript" else null_risks(lines.limit(0))
    return found | {"flows": flows, "nil_sources": nils, "statistics": keep(statistics(found["sources"], found["sinks"], flows, nils), "statistics")}


def described() -> Column:
    """A tracked flow in words, by its patterns' descriptions."""
    return F.concat(
        F.lit("Data from "), "source_type", F.lit(" ("), "source_pattern", F.lit(") in variable '"), "variable", F.lit("' flows to "), "sink_type", F.lit(" ("), "sink_pattern", F.lit(")"),
        F.when(F.col("sanitized"), " [sanitized]").otherwise(" [unsanitized - potential vulnerability]"),
    )


def flow_path(source_file: Column, source_line: Column, source_pattern: Column, sink_line: Column, sink_pattern: Column) -> Column:
    """Source, how many lines lie between, sink."""
    name = F.substring_index(source_file, "/", -1)
    end = lambda line, what, p: F.concat(name, F.lit(":"), line, F.lit(f" - {what}: "), p)
    between = F.when(source_line < sink_line - 1, F.concat(F.lit("... "), sink_line - source_line - 1, F.lit(" lines ...")))
    return F.array_compact(F.array(end(source_line, "Source", source_pattern), between, end(sink_line, "Sink", sink_pattern)))


def numbered(path: Column) -> Column:
    """Steps 1..n."""
    return F.transform(path, lambda x, i: F.struct((i + 1).alias("step"), x.alias("text")))
