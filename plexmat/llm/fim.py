"""Fill-in-the-middle: every text is cut at two unit borders and its parts are put in another order, by SQL of DuckDB inside the tasks.

Spark hands each task Arrow batches; a batch is registered with the worker's own DuckDB connection (in memory, one thread),
one query cuts, draws, reorders and hashes all its rows, and the result goes back as Arrow: no row passes through Python.
Batches are taken SLICE_BYTES of text at a time, so a worker holds one slice and its result; a longer text is a slice of
its own. A draw depends on the seed and doc_id alone, so reruns and retried tasks agree.

A unit is a word with the white space before it, or the white space at the end. A null text counts as empty; a null doc_id as
the empty text in the draw. Empty texts, and texts that hold one of the three marks, stay plain. Repeated rows give equal rows; a table
without rows gives none; other columns are left alone, whatever their names. Texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import SPACE_CLASS, kept_in_worker

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rf"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+|[{SPACE_CLASS}]+"
#: Bytes of text that one query of a worker reads.
SLICE_BYTES = 8 << 20


def transform_sql(table: str, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> str:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and output of every row of table (doc_id, text)."""
    number = "('0x' || substr(hash, {0}, 8))::BIGINT"
    return rf"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('{int(seed)}:' || coalesce(doc_id::VARCHAR, '')) AS hash
        FROM {table}
    ),
    drawn AS (
        SELECT doc_id, text, units, len(units) AS n, {number.format(1)} % (len(units) + 1) AS a, {number.format(9)} % (len(units) + 1) AS b,
            CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {number.format(17)} % 100 >= {int(percent)} THEN 'plain'
                WHEN {number.format(25)} % 100 < {int(spm_percent)} THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    ),
    parted AS (
        SELECT doc_id, text, n, form,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(a, b)), '') END AS prefix,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') END AS middle,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(a, b) + 1, n), '') END AS suffix
        FROM drawn
    )
    SELECT doc_id, text, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM parted"""


def _between(start: str, end: str) -> str:
    """What stands between two marks of output, each of which it holds once."""
    rest = f"substr(output, strpos(output, '{start}') + {len(start)})"
    return f"split_part({rest}, '{end}', 1)" if end else rest


#: The text of a row of (output, form). Marks cannot arise where parts meet, since only a mark's first character is "<".
RESTORED = f"""CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN {_between(PREFIX, SUFFIX)} || {_between(MIDDLE, "")} || {_between(SUFFIX, MIDDLE)}
    WHEN 'spm' THEN {_between(PREFIX, MIDDLE)} || {_between(MIDDLE, "")} || {_between(SUFFIX, PREFIX)} END"""


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each, without copies."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _mapped(df: DataFrame, column: str, sql: str, schema: str) -> DataFrame:
    """sql over the table `batch`, for every slice of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = kept_in_worker("duckdb", _connection)
        for x in batches:
            for part in _slices(x, column):
                con.register("batch", pa.Table.from_batches([part]))
                found = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from found.to_batches()

    return df.mapInArrow(run, schema)


def transform_documents(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars and the output text."""
    sql = f"SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM ({transform_sql('batch', seed, percent, spm_percent)})"
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(own, "text", sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_documents(made: DataFrame) -> DataFrame:
    """doc_id and text of every row of transform_documents, from output and form alone; null where either is null."""
    return _mapped(made.select("doc_id", "form", "output"), "output", f"SELECT doc_id, {RESTORED} AS text FROM batch", "doc_id long, text string")


def digest_documents(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """transform_documents with digests of the output and of the text restored from it; texts don't leave the tasks."""
    sql = f"""SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED}) AS restored_sha256
    FROM ({transform_sql("batch", seed, percent, spm_percent)})"""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(own, "text", sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
