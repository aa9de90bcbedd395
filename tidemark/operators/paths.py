"""Paths and file sets: status routing, extensions, packages, set operations, globs."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.operators.grouping import numbered_rows


def extension(path: Column) -> Column:
    """from the last dot of the base name; a hidden file has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def clean(path: Column) -> Column:
    """Single slashes, no "." steps, no slash at the end; ".." steps fold over the segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    fold = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    out = F.array_join(fold, "/")
    rooted = F.concat(F.lit("/"), F.regexp_replace(out, r"^(\.\./?)+", ""))
    return F.when(path.startswith("/"), rooted).when(out == "", ".").otherwise(out)


def status_code(status: Column) -> Column:
    """by the first letter."""
    return F.when(F.substring(status, 1, 1).isin("M", "A", "D", "R", "C"), F.substring(status, 1, 1)).otherwise("?")


def bucket(status: Column) -> Column:
    """added, deleted, and all else modified."""
    s = F.substring(status, 1, 1)
    return F.when(s == "A", "added").when(s == "D", "deleted").otherwise("modified")


def language(path: Column, extensions: dict[str, str] = dims.SCOPE_EXTENSIONS) -> Column:
    """By the extension, whatever its case."""
    return dims.mapped(F.lower(extension(path)), extensions)


def of_language(files: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """unknown and mixed keep all."""
    if wanted in ("unknown", "mixed"):
        return files
    return files.where(language(F.col(path)) == wanted)


def packages(files: DataFrame, path: str = "path") -> DataFrame:
    """Parent directories, distinct, sorted."""
    return files.select(dir_name(F.col(path)).alias("package")).distinct().orderBy("package")


def languages(files: DataFrame, path: str = "path") -> DataFrame:
    """The languages, and the one of them, mixed or unknown."""
    known = F.sort_array(F.collect_set(language(F.col(path))))
    return files.agg(known.alias("languages")).select("languages", one_language(F.col("languages")).alias("language"))


def presence(base: DataFrame, work: DataFrame) -> DataFrame:
    """Status from presence at the base and in the worktree, by path."""
    b, w = base.select("path").distinct().withColumn("b", F.lit(True)), work.select("path").distinct().withColumn("w", F.lit(True))
    return b.join(w, "path", "full_outer").select("path", F.when(F.col("b") & F.col("w"), "M").when(F.col("w"), "A").otherwise("D").alias("status"))


def with_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Line counts by cleaned path, 0 where there are none."""
    c = counts.select(clean(F.col("path")).alias("__clean"), "additions", "deletions")
    return files.withColumn("__clean", clean(F.col("path"))).join(c, "__clean", "left").drop("__clean").fillna(0, ["additions", "deletions"])


def _segment_regex(segment: str) -> str:
    """One segment of a glob: *, ?, [...] classes with ranges and ^, and backslash escapes; none of them goes across a slash."""
    out, i, n = "", 0, len(segment)

    def char(at: int) -> tuple[str, int]:
        if at < n and segment[at] == "\\":
            at += 1
        if at >= n:
            raise ValueError(f"bad glob segment {segment!r}")
        return segment[at], at + 1

    while i < n:
        c = segment[i]
        if c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            i += 1
            negated = segment[i : i + 1] == "^"
            i += negated
            ranges = ""
            while True:
                if i < n and segment[i] == "]" and ranges:
                    i += 1
                    break
                if i >= n or segment[i] in "-]":
                    raise ValueError(f"bad glob segment {segment!r}")
                lo, i = char(i)
                hi = lo
                if segment[i : i + 1] == "-":
                    if segment[i + 1 : i + 2] in ("]", "-", ""):
                        raise ValueError(f"bad glob segment {segment!r}")
                    hi, i = char(i + 1)
                if lo <= hi:
                    ranges += f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}"
                else:
                    ranges += "&&[^\\x{0}-\\x{10ffff}]"  # an empty range
            out += f"(?:(?!/)[{'^' * negated}{ranges}])"
        else:
            c, i = char(i)
            out += re.escape(c)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored expression for a glob: a segment ** stands for any number of segments; within another segment ** is as *."""
    segments = posixpath.normpath(pattern).split("/")
    out = ""
    for i, s in enumerate(segments):
        end = i == len(segments) - 1
        if s == "**":
            out += ".*" if end and i == 0 else "(?:/.*)?" if end else "(?:[^/]*/)*"
            continue
        more = not end and not (segments[i + 1] == "**" and i + 1 == len(segments) - 1)
        out += _segment_regex(s) + "/" * more
    return f"^{out}$"


def checked_pattern(pattern: str) -> str:
    """a glob that is relative, not empty and without steps upwards; else an error."""
    if not pattern:
        raise ValueError("pattern cannot be empty")
    if "\0" in pattern:
        raise ValueError("pattern contains null byte")
    if pattern.startswith("/"):
        raise ValueError(f"pattern must be relative: {pattern}")
    if posixpath.normpath(pattern) == ".":
        raise ValueError("pattern must not be current directory")
    if ".." in posixpath.normpath(pattern).replace("\\", "/").split("/"):
        raise ValueError(f"pattern contains path traversal: {pattern}")
    return pattern


def expand(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files that match any glob, outside .git, node_modules and vendor. A pattern that is no valid glob is an error."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(path).rlike(glob_regex(checked_pattern(p)))
    return files.where(hit & ~F.col(path).rlike(r"(^|/)(\.git|node_modules|vendor)/"))


def touched(changed: DataFrame) -> DataFrame:
    """Every path, both sides of renames, with the place where it came first."""
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("path").alias("p")), F.struct(F.lit(1).alias("k"), F.col("old_path").alias("p")))
    rows = changed.select("ord", F.explode(both).alias("x")).where("x.p is not null and x.p <> ''")
    return rows.groupBy(F.col("x.p").alias("path")).agg(F.min(F.col("ord") * 2 + F.col("x.k")).alias("first_ord"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with their first place."""
    return rows.groupBy(value).agg(F.min(order).alias("first_ord"))


def common_ancestor(files: DataFrame, path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """The deepest directory that holds all files, "." where they share none. Only two paths meet, the least and the greatest; with a slash behind, what these two share all share."""
    folder = F.concat(dir_name(F.col(path)), F.lit("/"))
    ends = files.groupBy(*by).agg(F.min(folder).alias("a"), F.max(folder).alias("z"))
    a, z = F.split("a", "/"), F.split("z", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(z)) - 1), lambda i: F.slice(a, 1, i) == F.slice(z, 1, i))
    shared = F.array_join(F.slice(a, 1, F.size(F.filter(same, lambda x: x))), "/")
    return ends.select(*by, F.when(shared == "", F.when(F.col("a").startswith("/"), "/").otherwise(".")).otherwise(shared).alias("ancestor"))


def checked_count(files: DataFrame, most: int = 10_000) -> DataFrame:
    """The files; whoever reads them gets an error where there are more than most. The count is part of the plan and looks at most + 1 rows."""
    n = files.limit(most + 1).agg(F.count(F.lit(1)).alias("__n"))  # one row
    fine = F.when(F.col("__n") > most, F.raise_error(F.lit(f"too many files: more than {most}"))).otherwise(F.lit(True))
    return files.crossJoin(F.broadcast(n.select(fine.alias("__fine")))).where("__fine").drop("__fine")


def path_error(path: Column) -> Column:
    """why a path is not taken, null if it is: empty, a null byte, absolute, steps upwards."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "path cannot be empty").when(F.contains(path, F.lit("\0")), "path contains null byte").when(path.startswith("/"), "path must be relative")
        .when(F.array_contains(F.split(F.replace(clean(path), F.lit("\\"), F.lit("/")), "/"), ".."), "path contains path traversal")
    )


def ref_error(ref: Column) -> Column:
    """why a revision's name is not taken, null if it is; an empty one stands for the usual revision."""
    return F.when(ref.startswith("-"), "ref cannot start with -").when(~ref.rlike(r"^[A-Za-z0-9._/\-:@~^]*$"), "ref contains unsupported character")


def identifier_error(name: Column) -> Column:
    """why a function's name is not taken, null if it is."""
    return F.when(F.coalesce(name, F.lit("")) == "", "name cannot be empty").when(~name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$.]*$"), "name contains invalid characters")


def diffs_of(diffs: DataFrame, language: str) -> DataFrame:
    """the diffs of one language, by any of its names."""
    wanted = dims.LANGUAGE_ALIASES.get(language.lower(), "")
    return diffs.where((dims.language_of(F.col("language")) == wanted) & F.lit(wanted != ""))


def diff_languages(diffs: DataFrame) -> DataFrame:
    """How many diffs each language has, known languages in their fixed order, others behind them by name."""
    n = diffs.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(dims.mapped(F.col("language"), dims.LANGUAGE_PRIORITY, 99), "language")


def one_language(known: Column) -> Column:
    """Of a set of languages the only one, mixed or unknown."""
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, F.get(known, F.lit(0))).otherwise("mixed")


def scope(changed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files by bucket, languages and the one of them, packages and totals, by the given columns. changed: path, status, old_path, additions, deletions.

    Packages are those of the files of the one language, or of all files where there is no such
    one. Renamed are renames and copies that name another old path; they are among the modified.
    """
    b = bucket(F.col("status"))
    known = F.sort_array(F.collect_set(language(F.col("path"))))
    folder = dir_name(F.col("path"))
    out = changed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_files"), *(F.count_if(b == x).alias(x) for x in ("modified", "added", "deleted")), F.count_if(is_rename()).alias("renamed"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("total_additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletions"),
        F.count_distinct(folder).alias("__all"), F.count_distinct(F.when(language(F.col("path")).isNotNull(), folder)).alias("__typed"), known.alias("__known"),
    )
    packages = F.when(F.size("__known") == 1, F.col("__typed")).otherwise(F.col("__all")).alias("packages")
    return out.select("*", packages, F.array_join("__known", ",").alias("languages"), one_language(F.col("__known")).alias("language")).drop("__known", "__all", "__typed")


def is_rename() -> Column:
    """a rename or copy with another old path."""
    return F.substring("status", 1, 1).isin("R", "C") & (F.coalesce(F.col("old_path"), F.lit("")) != "") & (F.col("old_path") != F.col("path"))


#: Lists of a scope by their place in its document.
SCOPE_LISTS = ("languages", "modified", "added", "deleted", "renamed", "packages")


def scope_entries(changed: DataFrame) -> DataFrame:
    """What the lists of a scope hold: section, ord (its place, or 0 where values are sorted), value, old_path. changed: ord, path, status, old_path."""
    typed = language(F.col("path"))
    files = changed.select(bucket(F.col("status")).alias("section"), "ord", F.col("path").alias("value"), F.lit(None).cast("string").alias("old_path"))
    renamed = changed.where(is_rename()).select(F.lit("renamed").alias("section"), "ord", F.col("path").alias("value"), "old_path")
    known = changed.select(typed.alias("value")).where("value is not null").distinct()
    many = known.agg((F.count(F.lit(1)) == 1).alias("__one"))  # one row
    folders = changed.select(dir_name(F.col("path")).alias("value"), typed.isNotNull().alias("__typed")).groupBy("value").agg(F.bool_or("__typed").alias("__typed"))
    packages = folders.crossJoin(F.broadcast(many)).where("__typed or not __one")

    def named(rows: DataFrame, section: str) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"), "value", F.lit(None).cast("string").alias("old_path"))

    return files.unionByName(renamed).unionByName(named(known, "languages")).unionByName(named(packages, "packages"))


def json_text(c: Column) -> Column:
    """A JSON string; what could end a script or a line in it is written as an escape."""
    out = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    out = F.substring(out, F.lit(2), F.length(out) - 2)
    for plain, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(plain), F.lit(escape))
    return out


def scope_document(changed: DataFrame, base: str = "", head: str = "") -> DataFrame:
    """The scope as a JSON document, in blocks of whole lines: part, ord, text. changed: ord, path, status, old_path, additions, deletions.

    A file is a row, wherever it lies; only counts are looked at as a whole. Written block by block
    (sinks.write_blocks), a scope of any size is one document.
    """
    entries = numbered_rows(scope_entries(changed).withColumn("__section", dims.mapped(F.col("section"), {s: i for i, s in enumerate(SCOPE_LISTS)}, 9)), ["__section", "ord", "value"])
    ends = entries.groupBy("section").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    found = scope(changed).crossJoin(ends.agg(*(F.coalesce(F.max(F.when(F.col("section") == s, F.col("last"))), F.lit(0)).alias(f"n_{s}") for s in SCOPE_LISTS)))
    out = None

    def put(part: int, *texts) -> None:
        nonlocal out
        row = found.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(*(F.lit(t) if isinstance(t, str) else t for t in texts)).alias("text"))
        out = row if out is None else out.unionByName(row)

    def opened(name: str, section: str, pad: str, after: str) -> tuple:
        return (f'{pad}"{name}": [', F.when(F.col(f"n_{section}") > 0, "\n").otherwise("]" + after))

    def closed(section: str, pad: str, after: str) -> Column:
        return F.when(F.col(f"n_{section}") > 0, f"{pad}]{after}").otherwise("")

    two, four = "  ", "    "
    put(0, '{\n  "base_ref": ', json_text(F.lit(base)), ',\n  "head_ref": ', json_text(F.lit(head)), ',\n  "language": ', json_text(F.col("language")), ",\n", *opened("languages", "languages", two, ",\n"))
    put(2, closed("languages", two, ",\n"), '  "files": {\n', *opened("modified", "modified", four, ",\n"))
    for k, (s, after) in enumerate((("modified", "added"), ("added", "deleted"), ("deleted", "renamed"))):
        put(4 + 2 * k, closed(s, four, ",\n"), *opened(after, after, four, "\n" if after == "renamed" else ",\n"))
    numbers = [x for c in ("total_files", "total_additions", "total_deletions") for x in (f'    "{c}": ', F.col(c).cast("string"), ",\n" if c != "total_deletions" else "\n")]
    put(10, closed("renamed", four, "\n"), '  },\n  "stats": {\n', *numbers, "  },\n", *opened("packages_affected", "packages", two, "\n"))
    put(12, closed("packages", two, "\n"), "}\n")
    pad = F.when(F.col("section").isin("languages", "packages"), four).otherwise("      ")
    pair = F.concat(F.lit('{\n        "old_path": '), json_text(F.col("old_path")), F.lit(',\n        "new_path": '), json_text(F.col("value")), F.lit("\n      }"))
    shown = F.when(F.col("section") == "renamed", pair).otherwise(json_text(F.col("value")))
    last = entries.join(F.broadcast(ends), "section")  # one row for each list
    rows = last.select((2 * F.col("__section") + 1).cast("int").alias("part"), F.col("nth").cast("long").alias("ord"), F.concat(pad, shown, F.when(F.col("nth") == F.col("last"), "\n").otherwise(",\n")).alias("text"))
    return out.unionByName(rows)


def scope_files(files: DataFrame, base: DataFrame, work: DataFrame, counts: DataFrame) -> DataFrame:
    """C17: the files of a list as changes: cleaned, distinct, status from presence, line counts; a file that is nowhere is left out. All: path."""
    wanted = files.select(clean(F.col("path")).alias("path")).distinct()
    status = presence(base.join(wanted, "path", "left_semi"), work.join(wanted, "path", "left_semi"))
    return with_counts(status, counts)


def scope_mode(mode: str, committed: DataFrame, staged: DataFrame, against_head: DataFrame, unstaged: DataFrame, at_head: DataFrame, in_worktree: DataFrame) -> DataFrame:
    """Path, status, old_path, additions, deletions of a scope.

    refs: two revisions (committed); staged: the index against HEAD; all: the one difference of HEAD
    and the working tree (against_head); unstaged: a list of names (unstaged: path, tracked or not),
    with status by presence at HEAD and in the working tree and counts against HEAD, as in C17.
    """
    parts = {"refs": committed, "staged": staged, "all": against_head}
    if mode in parts:
        return parts[mode].select("path", "status", "old_path", "additions", "deletions")
    if mode != "unstaged":
        raise ValueError(f"unknown scope mode: {mode}")
    rows = scope_files(unstaged, at_head, in_worktree, against_head.select("path", "additions", "deletions"))
    return rows.select("path", "status", F.lit(None).cast("string").alias("old_path"), "additions", "deletions")
