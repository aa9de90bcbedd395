"""Fill-in-middle documents, cut by a matcher that reads a text twice and keeps no list of its units.

A unit is a word with the white space before it, or white space at the end of a text. The first
pass over the matches counts the units; two ranks follow from the document's id; the second pass
advances a lazy iterator of matches to both ranks and notes where they end. Beside the text and
the result a text needs a few numbers, whatever its length.

A text goes out as it is (form "plain") if it is empty, holds a mark of its own, or its id says so;
otherwise prefix, suffix and middle follow each other behind their marks ("psm"), or the suffix
comes first ("spm"). No mark can arise where parts meet, as a mark has "<" at its start alone, so
restored() finds the parts again in the output.

A null text counts as empty; a null id is hashed as an empty one. Very long texts are cut whole,
rows that repeat an id and a text get the same result each, other columns are left alone whatever
their names, an empty table gives an empty result. A row is cut where it is read: nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, table

NAME = "op11_fill_in_middle"
SEED, FIM_PERCENT, SPM_PERCENT = "42", 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_UNITS = re.compile(_UNIT)


def count_units(text: str) -> int:
    return sum(1 for _ in _UNITS.finditer(text))


def ends_of(text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first low and the first high units end, low <= high, from one walk over the matches."""
    units = _UNITS.finditer(text)

    def after(end: int, steps: int) -> int:
        last = next(islice(units, steps - 1, None), None) if steps else None
        return last.end() if last else end

    first = after(0, low)
    return first, after(first, high - low)


def transformed(text: str, doc_id: int | None, seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    n = count_units(text)
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends_of(text, low, high)
    parts = (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]) if h4 % 100 < spm_percent else (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return n, "spm" if parts[0] == SUFFIX else "psm", a, b - a, "".join(parts)


def fill_in_middle(docs: DataFrame, seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        for b in batches:
            rows = [transformed(t or "", i, seed, fim_percent, spm_percent) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            columns[4] = columns[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output stands for, from the output and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _number(k: int) -> str:
    return f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u, {", ".join(_number(k) for k in range(4))} FROM documents
), f AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1 : lo], '') AS a, array_to_string(u[lo + 1 : hi], '') AS m, array_to_string(u[hi + 1 : n], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('{PREFIX}', a, '{SUFFIX}', s, '{MIDDLE}', m) ELSE concat('{SUFFIX}', s, '{PREFIX}', a, '{MIDDLE}', m) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
