"""Fill-in-middle against a plain version that cuts one text at a time."""

import hashlib
import re

import pyarrow as pa
import pytest
from conftest import make
from hypothesis import given, settings
from hypothesis import strategies as st

from versoline.llm import infill


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    output = {"plain": text, "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
    sizes = (None, None) if form == "plain" else (len(x), len(y))
    return doc_id, len(units), form, *sizes, output


def test_whole_table(spark, edge_rows):
    rows = [*edge_rows, (20, "a <P> b"), (21, "ends <S"), (22, "\x1e1\x1f\x1e0 a\x1f"), (23, "x" * 300_000 + " \n" * 50_000)]
    rows += [(100 + k, f"word{k} and <more, té; \x1f\n") for k in range(200)]
    docs = make(spark, rows)
    got = infill.transform(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_version(*r) for r in rows), key=key)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    back = infill.restore(got)
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert infill.digests(docs).count() == len(rows)


def test_empty_and_clashing(spark):
    assert infill.digests(make(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "one two", "x", 3, "q")], "doc_id bigint, text string, output string, n int, id string")
    assert [tuple(r) for r in infill.transform(docs).collect()] == [plain_version(1, "one two")]
    with pytest.raises(ValueError):
        infill.restore(infill.transform(docs), to="form")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab <>PSM\x1e\x1f01é日\n😀"), max_size=40), min_size=1, max_size=8))
def test_any_text_comes_back(texts):
    import numpy as np

    h = [np.array([int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i in range(len(texts))]) for k in range(4)]
    n, form, before, between, output = (x.to_pylist() for x in infill.infill_batch(pa.array(texts, pa.string()), h))
    assert list(zip(range(len(texts)), n, form, before, between, output)) == [plain_version(i, t) for i, t in enumerate(texts)]
    assert infill.restore_batch(pa.array(output, pa.string()), pa.array(form)).to_pylist() == texts
