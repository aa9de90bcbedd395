"""Symbols and call sites of source files, as table functions over (file, content).

Python is parsed by the standard library; Go and TypeScript by scanners for top-level
declarations, which is what symbol diffs need. Files over MAX_BYTES and files that do not parse
give no rows; symbols_or_errors() gives a row with the reason for each of them.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MAX_BYTES = 10 << 20
#: What a parser raises for a file that it cannot parse.
UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
SYMBOL = "symbol_kind string, name string, kind string, sig string, body_hash string, start_line int, end_line int"
# Built-in functions whose calls are no call sites.
IGNORED = (
    "print", "len", "str", "int", "float", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed",
    "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "type", "super", "open", "input",
)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def python_symbols(content: str) -> Iterator[tuple]:
    """Functions and methods (Class.method), classes, module variables, imports; raises what ast.parse does."""
    tree = ast.parse(content)

    def function(n, prefix=""):
        args = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in (*n.args.posonlyargs, *n.args.args)]
        args += [f"*{n.args.vararg.arg}"] if n.args.vararg else []
        args += [a.arg for a in n.args.kwonlyargs] + ([f"**{n.args.kwarg.arg}"] if n.args.kwarg else [])
        sig = f"({', '.join(args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
        yield "function", prefix + n.name, "async" if isinstance(n, ast.AsyncFunctionDef) else "def", sig, _hash("\n".join(map(ast.unparse, n.body))), n.lineno, n.end_lineno

    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield from function(n)
        elif isinstance(n, ast.ClassDef):
            fields = [f"{x.target.id}: {ast.unparse(x.annotation)}" for x in n.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
            yield "type", n.name, "class", f"({', '.join(map(ast.unparse, n.bases))}) {{{'; '.join(fields)}}}", "", n.lineno, n.end_lineno
            for m in n.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield from function(m, n.name + ".")
        elif isinstance(n, ast.Assign | ast.AnnAssign):
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(target, ast.Name):
                    yield "variable", target.id, "variable", ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else "", _hash(ast.unparse(n.value)) if n.value else "", n.lineno, n.end_lineno
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", a.name, "import", a.asname or "", "", n.lineno, n.end_lineno
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                yield "import", f"{'.' * n.level}{n.module or ''}.{a.name}", "from", a.asname or "", "", n.lineno, n.end_lineno


def _dotted(n: ast.expr) -> str:
    """Names and attributes joined by dots, as far as they go; "" for anything else."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    if isinstance(n, ast.Name):
        parts.append(n.id)
    return ".".join(parts[::-1])


def call_target(f: ast.expr) -> str:
    """What a call calls: a dotted name, <subscript>, <chained>, or "" for other expressions."""
    if isinstance(f, ast.Subscript):
        return "<subscript>"
    return "<chained>" if isinstance(f, ast.Call) else _dotted(f)


#: Fields of nodes that hold no calls and no functions, and nodes that hold none themselves.
_PLAIN_FIELDS = frozenset(("ctx", "op", "ops", "id", "attr", "name", "arg", "type_comment", "kind", "module", "level", "simple", "is_async", "conversion"))
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias))


def _inner_nodes(n: ast.AST) -> list[ast.AST]:
    """The nodes below, as ast.iter_child_nodes gives them, without those that cannot hold a call or a function."""
    out = []
    for f in n._fields:
        if f not in _PLAIN_FIELDS:
            v = getattr(n, f, None)
            if type(v) is list:
                out += [x for x in v if isinstance(x, ast.AST) and type(x) not in _LEAVES]
            elif isinstance(v, ast.AST) and type(v) not in _LEAVES:
                out.append(v)
    return out


def python_calls(content: str) -> Iterator[tuple]:
    """Caller, target, line, column from 1, is_method of each call.

    Every function has its calls, nested ones too, without those of functions inside it; one in a
    class is named by the innermost class. Calls whose last name is a built-in are skipped.
    """
    try:
        tree = ast.parse(content)
    except UNPARSABLE:
        return
    functions = ast.FunctionDef | ast.AsyncFunctionDef
    found: list[tuple[str, functions]] = []
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        n, owner = stack.pop()
        if isinstance(n, functions):
            found.append((f"{owner}.{n.name}" if owner else n.name, n))
        inside = n.name if isinstance(n, ast.ClassDef) else owner
        stack += [(x, inside) for x in reversed(_inner_nodes(n))]
    for name, function in found:
        todo = deque(_inner_nodes(function))
        while todo:
            n = todo.popleft()
            if isinstance(n, functions):
                continue
            todo.extend(_inner_nodes(n))
            if isinstance(n, ast.Call) and (target := call_target(n.func)) and target.rsplit(".", 1)[-1] not in IGNORED:
                yield name, target, n.lineno, n.col_offset + 1, isinstance(n.func, ast.Attribute)


def _masked(text: str, quotes: str) -> str:
    """The text with comments and strings blanked, line breaks kept."""
    pattern = r"//[^\n]*|/\*.*?\*/|" + "|".join(rf"{q}(?:\\.|[^{q}\\])*{q}" if q != "`" else r"`[^`]*`" for q in quotes)
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _block_end(masked: str, at: int) -> int:
    """After the brace that closes the first one from at on."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def go_symbols(content: str) -> Iterator[tuple]:
    """S27, best effort: functions and methods (Receiver.Name, without the asterisk), types, top-level vars and consts, imports."""
    masked = _masked(content, "\"'`")
    line = lambda i: content.count("\n", 0, i) + 1
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?(\*?)(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*(\([^{]*?)\{", masked, re.M):
        end = _block_end(masked, m.end() - 1)
        body = re.sub(r"\s+", " ", content[m.end() : end - 1]).strip()
        yield "function", f"{m[2]}.{m[3]}" if m[2] else m[3], "method" if m[2] else "func", re.sub(r"\s+", " ", content[m.start(4) : m.end(4)]).strip(), _hash(body), line(m.start()), line(end - 1)
    for m in re.finditer(r"^type\s+(\w+)\s+(struct|interface|[^\n{]+)", masked, re.M):
        end = _block_end(masked, m.end()) if m[2] in ("struct", "interface") else m.end()
        inside = content[m.end() : end] if m[2] in ("struct", "interface") else m[2]
        yield "type", m[1], m[2] if m[2] in ("struct", "interface") else "alias", "; ".join(" ".join(x.split()) for x in inside.strip("{} \n").split("\n") if x.split()), "", line(m.start()), line(end - 1)
    for m in re.finditer(r"^(var|const)\s+(\w+)([^\n=]*)(?:=\s*([^\n]*))?", masked, re.M):
        yield "variable", m[2], m[1], m[3].strip(), _hash(content[m.start(4) : m.end(4)].strip())[:16] if m[4] else "", line(m.start()), line(m.end())
    for m in re.finditer(r"^(var|const)\s*\(", masked, re.M):
        end = _paren_end(masked, m.end() - 1)
        for x in re.finditer(r"^[ \t]+(\w+)([^\n=]*)(?:=\s*([^\n]*))?$", masked[m.end() : end - 1], re.M):
            lo = m.end() + x.start()
            yield "variable", x[1], m[1], " ".join(x[2].split()), _hash(content[m.end() + x.start(3) : m.end() + x.end(3)].strip())[:16] if x[3] else "", line(lo), line(lo)
    for m in re.finditer(r'^import\s+(?:\(([^)]*)\)|((?:\w+\s+)?"[^"\n]+"))', content, re.M):
        for x in re.finditer(r'(?:([\w.]+)\s+)?"([^"\n]+)"', m[1] or m[2]):
            yield "import", x[2], "import", x[1] or "", "", line(m.start()), line(m.start())


def typescript_symbols(content: str) -> Iterator[tuple]:
    """S29, best effort: functions, arrow functions, classes, interfaces, aliases, imports at the top level."""
    masked = _masked(content, "\"'`")
    line = lambda i: content.count("\n", 0, i) + 1
    for m in re.finditer(r"^(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)\s*(\([^{]*?)\{", masked, re.M):
        end = _block_end(masked, m.end() - 1)
        yield "function", m[2], "async" if m[1] else "function", " ".join(content[m.start(3) : m.end(3)].split()), _hash(" ".join(content[m.end() : end - 1].split())), line(m.start()), line(end - 1)
    for m in re.finditer(r"^(?:export\s+)?const\s+(\w+)[^=\n]*=\s*(async\s+)?(\([^=]*?\)[^=]*?)=>", masked, re.M):
        yield "function", m[1], "async" if m[2] else "arrow", " ".join(content[m.start(3) : m.end(3)].split()), _hash(" ".join(content[m.end() : content.find("\n\n", m.end())].split())), line(m.start()), line(m.end())
    for m in re.finditer(r"^(?:export\s+)?(?:abstract\s+)?(class|interface)\s+(\w+)[^{]*\{", masked, re.M):
        end = _block_end(masked, m.end() - 1)
        yield "type", m[2], m[1], " ".join(content[m.end() : end - 1].split()), "", line(m.start()), line(end - 1)
    for name, lo, hi in typescript_functions(masked):
        if "." in name:
            at = masked.rfind("(", 0, lo)
            head = masked.rfind(name.split(".", 1)[1], 0, lo)
            yield "function", name, "method", " ".join(content[masked.find("(", head) if head >= 0 else at : lo].split()), _hash(" ".join(content[lo + 1 : hi - 1].split())), line(head if head >= 0 else lo), line(hi - 1)
    for m in re.finditer(r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)\s*\{", masked, re.M):
        end = _block_end(masked, m.end() - 1)
        yield "type", m[1], "enum", " ".join(content[m.end() : end - 1].split()), "", line(m.start()), line(end - 1)
    for m in re.finditer(r"^(?:export\s+)?type\s+(\w+)[^=]*=\s*([^;\n]*)", masked, re.M):
        yield "type", m[1], "alias", content[m.start(2) : m.end(2)].strip(), "", line(m.start()), line(m.end())
    for m in re.finditer(r"""^import\s+(?:([^'"\n]*?)\s+from\s+)?['"]([^'"\n]+)['"]""", content, re.M):
        yield "import", m[2], "import", m[1] or "", "", line(m.start()), line(m.end())


_TS_WORDS = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "constructor", "void", "delete", "in", "of", "do", "else", "yield", "throw", "case"))
_TS_FUNCTION = re.compile(r"(?:\b(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>()]*>)?\s*\(|\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b[^(]*\(|(?:<[^>()]*>\s*)?\(|(?=\w+\s*=>)))")
_TS_CLASS = re.compile(r"\bclass\s+(\w+)[^{]*\{")
_TS_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*([#\w]+)\s*(?:<[^>()]*>)?\s*\(")
_TS_CALL = re.compile(r"(\bnew\s+)?((?:\bthis\b|\bsuper\b|[A-Za-z_$][\w$]*)(?:\s*(?:\?\.|\.)\s*[A-Za-z_$#][\w$]*|\[[^\[\]\n]*\])*)\s*(?:<[\w\s,\[\]|.]*>)?\s*(?:\?\.)?\(")


def _paren_end(masked: str, at: int) -> int:
    """After the bracket that closes the one at a place."""
    depth = 0
    for m in re.compile(r"[()]").finditer(masked, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _body(masked: str, after: int, arrow: bool) -> tuple[int, int] | None:
    """Where the body behind a parameter list begins and ends; None for a declaration without one."""
    m = re.compile(r"\s*(?::[^={};]*)?=>\s*" if arrow else r"\s*(?::[^{;=]*)?(?=\{)").match(masked, after)
    if not m:
        return None
    if masked.startswith("{", m.end()):
        return m.end(), _block_end(masked, m.end())
    if not arrow:
        return None
    depth = 0
    for x in re.compile(r"[()\[\]{}]|[;\n,]").finditer(masked, m.end()):
        if x[0] in "([{":
            depth += 1
        elif x[0] in ")]}":
            depth -= 1
            if depth < 0:
                return m.end(), x.start()
        elif depth == 0 and x[0] != ",":
            return m.end(), x.start()
    return m.end(), len(masked)


def typescript_functions(masked: str) -> Iterator[tuple[str, int, int]]:
    """Name, body's begin and end of functions, of names that hold a function, and of methods (Class.method)."""
    for m in _TS_FUNCTION.finditer(masked):
        if m[0].endswith("("):
            after = _paren_end(masked, m.end() - 1)
            arrow = bool(m[2]) and "function" not in m[0]
        else:  # one parameter without brackets
            after, arrow = m.end() + len(re.compile(r"\w+").match(masked, m.end())[0]), True
        if (body := _body(masked, after, arrow)) is not None:
            yield m[1] or m[2], *body
    for c in _TS_CLASS.finditer(masked):
        end, at = _block_end(masked, c.end() - 1) - 1, c.end()
        while m := _TS_METHOD.search(masked, max(at - 1, c.end() - 1), end):
            at = _paren_end(masked, m.end() - 1)
            if m[1] in _TS_WORDS:
                continue
            if (body := _body(masked, at, False)) is not None:
                yield f"{c[1]}.{m[1]}", *body
                at = body[1]


def typescript_calls(content: str) -> Iterator[tuple]:
    """S32, light mode: caller, target, line, column (1), is_method of the calls and constructions in each function's body, nested ones included. A scanner, not a compiler: generics and odd layouts are best effort."""
    masked = _masked(content, "\"'`")
    line = lambda i: content.count("\n", 0, i) + 1
    for name, lo, hi in typescript_functions(masked):
        for m in _TS_CALL.finditer(masked, lo, hi):
            target = re.sub(r"\s+", "", m[2])
            first = target.split(".")[0].split("[")[0].rstrip("?")
            if first in _TS_WORDS and target == first:
                continue
            if re.search(r"\bfunction\s*\*?\s*$", masked[max(lo, m.start() - 12) : m.start()]):
                continue
            yield name, target, line(m.start()), 1, not m[1] and ("." in target or "[" in target)


_PARSERS = {"python": python_symbols, "go": go_symbols, "typescript": typescript_symbols}


@udtf(returnType=SYMBOL)
class Symbols:
    """(language, content) -> symbols, in the order of their place."""

    def eval(self, language: str, content: str):
        if content and language in _PARSERS and len(content.encode()) <= MAX_BYTES:
            try:
                yield from sorted(_PARSERS[language](content), key=lambda s: (s[5], s[0], s[1]))
            except UNPARSABLE:
                return


@udtf(returnType=SYMBOL + ", error string")
class SymbolsOrErrors:
    """(language, content) -> symbols, or one row with nothing but the error: a file that is not there (null), one over the cap, or one that does not parse."""

    def eval(self, language: str, content: str):
        nothing = (None,) * 7
        if content is None:
            yield *nothing, "failed to read file"
        elif len(content.encode()) > MAX_BYTES:
            yield *nothing, f"file exceeds maximum allowed size ({MAX_BYTES} bytes)"
        elif language in _PARSERS:
            try:
                found = sorted(_PARSERS[language](content), key=lambda s: (s[5], s[0], s[1]))
            except UNPARSABLE as e:
                why = f"line {e.lineno}: {e.msg}" if isinstance(e, SyntaxError) else str(e) or type(e).__name__
                yield *nothing, f"failed to parse {language} file: {why}"
            else:
                yield from ((*s, None) for s in found)


def dealt(files: DataFrame) -> DataFrame:
    """The files in as many tasks as a shuffle has: parsing takes far longer than reading, and a table of files small enough for one split would be parsed by one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def symbols_or_errors(files: DataFrame, language: str = "language", content: str = "content") -> DataFrame:
    """files: language, content, and any others -> a row for each symbol, or one with its error (and no symbol) for a file that could not be read."""
    return dealt(files).lateralJoin(SymbolsOrErrors(F.col(language).outer(), F.col(content).outer())).drop(content)


_CALLS = {"python": python_calls, "typescript": typescript_calls}


@udtf(returnType="caller string, target string, line int, column int, is_method boolean")
class CallSites:
    """(language, content) -> call sites. Go has none here: its edges are an input table."""

    def eval(self, language: str, content: str):
        if content and language in _CALLS and len(content.encode()) <= MAX_BYTES:
            yield from _CALLS[language](content)


def symbols(files: DataFrame, language: Column | str = "language", content: str = "content") -> DataFrame:
    """files: file, language, content, and any others -> a row for each symbol."""
    lang = F.col(language) if isinstance(language, str) else language
    return dealt(files).lateralJoin(Symbols(lang.outer(), F.col(content).outer())).drop(content)


def calls(files: DataFrame, content: str = "content", language: Column | str = "python") -> DataFrame:
    """Files: content and any others -> a row for each call site. language: one for all files, or a column."""
    lang = F.lit(language) if isinstance(language, str) else language.outer()
    return dealt(files).lateralJoin(CallSites(lang, F.col(content).outer())).drop(content)


def register(language: str, symbols_of: Callable[[str], Iterator[tuple]] | None = None, calls_of: Callable[[str], Iterator[tuple]] | None = None) -> None:
    """Another language's parsers, on the driver and in the workers that import them from here."""
    if symbols_of:
        _PARSERS[language] = symbols_of
    if calls_of:
        _CALLS[language] = calls_of


#: Bytes of a line from which on its file is not read.
MAX_LINE_BYTES = 1 << 20


def code_lines(files: DataFrame, content: str = "content", longest: int | None = MAX_LINE_BYTES) -> DataFrame:
    """File, line, text; one line end at the end of the content and a carriage return at the end of a line go. An empty or null content has no lines.

    Files over the cap are skipped whole, as are files with a line of longest bytes or more, its
    carriage return included (None: lines of any length).
    """
    small = files.where(F.octet_length(content).between(1, MAX_BYTES)).select("file", F.split(F.regexp_replace(content, r"\n\z", ""), "\n").alias("__lines"))
    if longest is not None:
        small = small.where(~F.exists("__lines", lambda x: F.octet_length(x) >= longest))
    rows = small.select("file", F.posexplode("__lines").alias("p", "t"))
    return rows.select("file", (F.col("p") + 1).alias("line"), F.regexp_replace("t", r"\r\z", "").alias("text"))
