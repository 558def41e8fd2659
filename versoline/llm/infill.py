"""Fill-in-middle transformation as a ``pyarrow.compute`` pipeline over whole batches.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``).  Per Arrow batch the units of all texts are split into list arrays,
flattened with their parents' indices, numbered inside their parents, filtered by role (prefix, middle, suffix), rebuilt into
lists and joined into pieces; the pieces are joined in the order of the text's form.  No Python code runs per row or unit.

Where a text is cut and which form it gets follow from ``sha256("1:<id>")`` alone, so reruns and other partitionings agree.

* null text: empty; empty text, or one that holds a marker: form ``plain``, passed on unchanged, piece lengths null;
* null id: the digest is that of ``"1:"``; repeated ids and rows: each row for itself; an empty table: no rows;
* very long text: the batch of that one text, so a worker holds a small multiple of the longest text;
* other columns are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import slices

# The markers of the three pieces, and the shares of the forms in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Separates units while they are split; ESCAPE keeps the two apart from the same characters in a text.
SPLIT, ESCAPE = "\x1f", "\x1e"
UNIT = f"({ESCAPE}[01]|[A-Za-z]+|[^A-Za-z])"


def digest_words(id_col: str) -> list[F.Column]:
    """The first four 32-bit words of the digest of an id."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def _protected(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, ESCAPE, ESCAPE + "0"), SPLIT, ESCAPE + "1")


def _plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, ESCAPE + "1", SPLIT), ESCAPE + "0", ESCAPE)


def _pieces(units: pa.Array, parents: np.ndarray, wanted: np.ndarray, rows: int) -> pa.Array:
    """The wanted units joined per parent."""
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(parents[wanted], minlength=rows), out=offsets[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), units.filter(pa.array(wanted)))
    return _plain(pc.binary_join(lists, pa.scalar("", pa.large_string())))


def infill_batch(texts: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of an array of texts without nulls."""
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    marked = pc.replace_substring_regex(_protected(texts), UNIT, SPLIT + r"\1")
    lists = pc.split_pattern(marked, SPLIT).cast(pa.large_list(pa.large_string()))
    flat = pc.list_flatten(lists)
    parents = pc.list_parent_indices(lists).to_numpy()
    starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
    ordinal = np.arange(len(flat)) - starts[parents] - 1  # the split leaves an empty string before the first unit
    n = pc.list_value_length(lists).to_numpy() - 1
    cuts = np.stack([h[0] % (n + 1), h[1] % (n + 1)])
    low, high = cuts.min(0), cuts.max(0)
    role = np.where(ordinal < 0, 3, (ordinal >= low[parents]).astype(np.int8) + (ordinal >= high[parents]))
    prefix, middle, suffix = (_pieces(flat, parents, role == k, rows) for k in range(3))
    plain = pc.or_(pc.or_(pa.array(n == 0), pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")), pa.array(h[2] % 100 >= PLAIN_FROM))
    spm = pa.array(h[3] % 100 < SPM_BELOW)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar("", pa.large_string())
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE)}
    psm = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, none)
    turned = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, none)
    output = pc.if_else(plain, texts, pc.if_else(spm, turned, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id (same name), ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    No shuffle; the result's order is the table's.
    """
    asked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *digest_words(id_col))
    kind = asked.schema["id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
            n, form, before, between, output = infill_batch(batch.column("text"), h)
            yield pa.RecordBatch.from_arrays([batch.column("id"), n, form, before, between, output.cast(pa.string())], names=["id", *names])

    out = asked.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def _split_once(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``mark``."""
    parts = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def restore_batch(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that ``infill_batch`` was given, from output and form alone."""
    outputs = outputs.cast(pa.large_string())
    result = [None] * 3
    names = ("plain", "psm", "spm")
    kinds = [pc.equal(forms, name) for name in names]
    result[0] = outputs.filter(kinds[0])
    for k, first, second in ((1, PREFIX, SUFFIX), (2, SUFFIX, PREFIX)):
        _, rest = _split_once(outputs.filter(kinds[k]), first)
        a, rest = _split_once(rest, second)
        b, middle = _split_once(rest, MIDDLE)
        prefix, suffix = (a, b) if first == PREFIX else (b, a)
        result[k] = pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar("", pa.large_string()))
    places = np.concatenate([np.flatnonzero(kind.to_numpy(zero_copy_only=False)) for kind in kinds])
    back = np.empty(len(places), np.int64)
    back[places] = np.arange(len(places))
    return pa.concat_arrays(result).take(pa.array(back))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with the exact original text in column ``to``; the inverse of ``transform``.  ``to`` must be a new name."""
    if to in rows.columns:
        raise ValueError(f"{to} is a column already")
    names = [*rows.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = restore_batch(batch.column(output_col), batch.column(form_col)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=names)

    return rows.mapInArrow(run, rows.schema.simpleString()[len("struct<"):-1] + f",{to}:string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    rows = restore(transform(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
