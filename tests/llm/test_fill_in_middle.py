import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle as fim

_TEXT = st.text(alphabet=st.sampled_from("ab<PSM> \t\n\x0b\x1c é\U0001f600"), max_size=60)


def by_lists(doc_id, text):
    """The contract with a list of all units."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    told = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    a, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    out = f"<S>{s}<P>{a}<M>{m}" if h4 % 100 < 80 else f"<P>{a}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 80 else "psm", len(a), len(m), out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 10**12)), _TEXT)
def test_as_with_lists(doc_id, text):
    assert fim.transformed(text, doc_id) == by_lists(doc_id, text)


def test_rows_nulls_repeats_long_and_clashing_names(spark):
    texts = [None, "", " ", "a", " a  b\tc \n", "x<P>y", "<S", "P>", "é \U0001f600 <M", "word " * 300_000, "y" * 1_000_000, " " * 1_000_000]
    rows = [(i, t, "z", 1) for i in range(8) for t in texts] + [(None, "a b c", "z", 1), (3, "a", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, *by_lists(i, t or "")) for i, t, *_ in rows), key=key)
    back = got.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_empty_table_and_no_shuffle(spark):
    got = fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
