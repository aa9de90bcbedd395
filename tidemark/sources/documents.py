"""JSON documents as a data source that is written in parallel and put in place at once.

    rows.write.format("json_documents").mode("append").save("/shared/folder")

Rows have name (the document's file name), value (the JSON text of one element), and may have member.
Without a member a document is a list of its elements; with members it is an object of lists, or of
single values for those that the option "single" names; those that the option "always" names are there,
as empty lists, without elements too. Elements come in the order of partitions and
of rows within them, members in the order of the option "members", others by name behind those.

A task writes pieces into a hidden folder beside the documents, an element at a time; its commit
message names pieces, elements and bytes, never contents. The commit puts pieces together in blocks
of a megabyte and renames whole documents; if anything fails, no document has changed and the hidden
folder is gone. A task that is tried again writes other pieces; only those of committed attempts
count. Files are for their owner alone, links are never followed.

Documents are meant for readers that take them whole, so one over "most" bytes (50 MB, what such a
reader accepts) is refused, as is one that exists in mode append; larger results are written as lines
(sinks.write_json), or, with the option "parts", such a document is written as several,
name.part-00000.json and on: documents of the same shape with a share of the elements each, in order,
single values in the first. The folder is a path that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.phases import MAX_BYTES

_NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*")
_CHUNK = 1 << 20


@dataclass
class Pieces(WriterCommitMessage):
    """What one task wrote: partition, and (name, member, file, elements, bytes) of each piece."""

    partition: int
    pieces: tuple[tuple[str, str | None, str, int, int], ...]


def _indented(value: str, by: str) -> str:
    return by + json.dumps(json.loads(value), indent=2, ensure_ascii=False).replace("\n", "\n" + by)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        names = set(schema.fieldNames())
        if not {"name", "value"} <= names or names - {"name", "value", "member"}:
            raise ValueError("json_documents takes the columns name, value and member")
        listed = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.members, self.single, self.most = listed("members"), frozenset(listed("single")), int(options.get("most", MAX_BYTES))
        self.always = listed("always")
        self.parts = options.get("parts", "false").lower() == "true"
        self.with_members, self.overwrite = "member" in names, overwrite
        self.staging = f"{self.path}/.documents-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Pieces:
        context = TaskContext.get()
        os.makedirs(self.staging, mode=0o700, exist_ok=True)
        stem = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        found: dict[tuple[tuple[str, str | None], int], list] = {}
        turns: dict[tuple[str, str | None], int] = {}
        key, out = None, None
        try:
            for row in rows:
                at = (row["name"], row["member"] if self.with_members else None)
                full = self.parts and at == key and piece[2] >= self.most // 8
                if at != key or full:
                    if not isinstance(at[0], str) or not _NAME.fullmatch(at[0]):
                        raise ValueError(f"invalid document name {at[0]!r}")
                    if self.with_members and at[1] is None:
                        raise ValueError(f"{at[0]}: an element without a member")
                    if out:
                        out.close()
                    turns[at] = turns.get(at, 0) + full
                    piece = found.setdefault((at, turns[at]), [f"{stem}-{len(found)}", 0, 0])
                    key, out = at, open(piece[0], "a", encoding="utf-8")
                depth = "" if at[1] in self.single else "    " if self.with_members else "  "
                if row["value"] is None:
                    raise ValueError(f"{at[0]}: an element without a value")
                text = (",\n" if piece[1] else "") + _indented(row["value"], depth)
                out.write(text)
                piece[1] += 1
                piece[2] += len(text.encode())
        finally:
            if out:
                out.close()
        return Pieces(context.partitionId(), tuple((*at, *piece) for (at, _), piece in found.items()))

    def _put_together(self, name: str, pieces: Sequence[tuple], to: str) -> None:
        by_member: dict[str | None, list[tuple]] = {}
        for p in pieces:
            by_member.setdefault(p[1], []).append(p)
        with open(to, "w", encoding="utf-8") as out:

            def copy(parts: Sequence[tuple], between: str) -> None:
                for n, part in enumerate(parts):
                    out.write(between if n else "")
                    with open(part[2], encoding="utf-8") as piece:
                        shutil.copyfileobj(piece, out, _CHUNK)

            if not self.with_members:
                out.write("[\n")
                copy(by_member[None], ",\n")
                out.write("\n]\n")
            else:
                rank = {m: i for i, m in enumerate(self.members)}
                out.write("{")
                for n, member in enumerate(sorted({*by_member, *self.always}, key=lambda m: (rank.get(m, len(rank)), m))):
                    out.write(("," if n else "") + f"\n  {json.dumps(member, ensure_ascii=False)}: ")
                    if member not in by_member:
                        out.write("[]")
                    elif member in self.single:
                        if sum(p[3] for p in by_member[member]) != 1:
                            raise ValueError(f"{name}: more than one value for {member}")
                        self._single(by_member[member][0][2], out)
                    else:
                        out.write("[\n")
                        copy(by_member[member], ",\n")
                        out.write("\n  ]")
                out.write("\n}\n")
            os.fchmod(out.fileno(), 0o600)

    @staticmethod
    def _single(piece: str, out) -> None:
        with open(piece, encoding="utf-8") as lines:
            for n, line in enumerate(lines):
                out.write(("  " if n else "") + line)

    def _shares(self, name: str, pieces: Sequence[tuple]) -> dict[str, list[tuple]]:
        """A document's pieces by the names of its parts; one that is small enough is whole."""
        if not self.parts or sum(p[4] for p in pieces) <= self.most:
            return {name: list(pieces)}
        stem, ending = os.path.splitext(name)
        out: dict[str, list[tuple]] = {}
        held: list[tuple] = []
        for p in sorted(pieces, key=lambda p: p[1] not in self.single):
            if held and sum(h[4] for h in held) + p[4] > self.most:
                held = []
            if not held:
                out[f"{stem}.part-{len(out):05d}{ending}"] = held
            held.append(p)
        return out

    def _replaced(self, whole: set[str], written: set[str]) -> list[str]:
        """Earlier forms of documents that are written again: parts of one that is whole now, or the other way round."""
        return [f for f in os.listdir(self.path) if f not in written and re.sub(r"\.part-\d{5}", "", f) in whole]

    def commit(self, messages: list[Pieces | None]) -> None:
        try:
            documents: dict[str, list[tuple]] = {}
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                for p in m.pieces:
                    documents.setdefault(p[0], []).append(p)
            whole = set(documents)
            documents = {part: share for name, pieces in documents.items() for part, share in self._shares(name, pieces).items()}
            stale = self._replaced(whole, set(documents)) if documents else []
            if stale and not self.overwrite:
                raise FileExistsError(f"{self.path}/{stale[0]}")
            for name, pieces in documents.items():
                size, to = sum(p[4] for p in pieces), f"{self.path}/{name}"
                if size > self.most:
                    raise ValueError(f"{name}: {size} bytes, more than {self.most}")
                if os.path.islink(to):
                    raise OSError(f"refusing to write to symlink path: {to}")
                if os.path.lexists(to) and not self.overwrite:
                    raise FileExistsError(to)
            for name, pieces in documents.items():
                self._put_together(name, pieces, f"{self.staging}/{name}")
            for name in documents:
                os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
            for name in stale:
                os.unlink(f"{self.path}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Pieces | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)


def write_documents(rows: DataFrame, path: str, order: Sequence[str] = ("ord",), overwrite: bool = False, **options: str) -> None:
    """Documents of rows (name, value, and member if there are any), their elements by order: split by ranges, so one large document is the work of many tasks. options: members, single, most, parts."""
    register(rows.sparkSession)
    keys = ["name", *(["member"] if "member" in rows.columns else []), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys[: len(keys) - len(order)], "value")
    dealt.write.format("json_documents").options(**options).mode("overwrite" if overwrite else "append").save(path)


def write_symbol_documents(documents: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    """Mixed-ast.json with every document and <language>-ast.json with a language's. documents: language (a token), document (JSON text), ord."""
    names = F.array(F.lit("mixed-ast.json"), F.concat("language", F.lit("-ast.json")))
    write_documents(documents.select(F.explode(names).alias("name"), F.col("document").alias("value"), "ord"), path, overwrite=overwrite, **options)


def write_finding_documents(findings: DataFrame, errors: DataFrame, versions: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    """Static-analysis.json over all languages and <language>-lint.json for each: tool_versions, findings, summary (a count for each severity, unknown ones among them) and, if there are any, errors.

    findings: language, ord, severity and others; errors: language, ord, error; versions: language,
    tool, version, a row for each tool. A language with none of them has no document;
    static-analysis.json is always written.
    """
    from tidemark.functions import dims

    names = F.array(F.lit("static-analysis.json"), F.concat("language", F.lit("-lint.json")))
    item = F.struct(*(c for c in findings.columns if c not in ("language", "ord")))
    found = findings.select(F.explode(names).alias("name"), F.lit("findings").alias("member"), F.to_json(item).alias("value"), F.col("ord").cast("long").alias("ord"))
    wrong = errors.select(F.explode(names).alias("name"), F.lit("errors").alias("member"), F.expr("substring(to_json(array(error)), 2, length(to_json(array(error))) - 2)").alias("value"), F.col("ord").cast("long").alias("ord"))
    # a row without a severity makes a document, one without a tool no entry
    bare = lambda d: d.select(F.explode(names).alias("name"), F.lit(None).cast("string").alias("severity"))
    always = findings.sparkSession.range(1).select(F.lit("static-analysis.json").alias("name"), F.lit(None).cast("string").alias("severity"))
    counted = findings.select(F.explode(names).alias("name"), "severity").unionByName(bare(errors)).unionByName(bare(versions)).unionByName(always)
    entry = F.when(F.col("tool").isNotNull(), F.struct("tool", "version"))
    tools = versions.select(F.explode(names).alias("name"), "tool", "version")
    by_tool = tools.unionByName(counted.select("name").distinct().select("name", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("version"))).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("m"))
    noted = by_tool.select("name", F.lit("tool_versions").alias("member"), F.to_json("m").alias("value"), F.lit(0).cast("long").alias("ord"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES] + [F.count_if(~F.col("severity").isin(*dims.SEVERITIES)).alias("unknown")]
    summary = counted.unionByName(always).groupBy("name").agg(*counts)
    told = summary.select("name", F.lit("summary").alias("member"), F.to_json(F.struct(*dims.SEVERITIES, "unknown")).alias("value"), F.lit(0).cast("long").alias("ord"))
    whole = found.unionByName(told).unionByName(wrong).unionByName(noted)
    write_documents(whole, path, overwrite=overwrite, members="tool_versions,findings,summary,errors", single="tool_versions,summary", always="findings", **options)
