"""Pages of PDF files: a table function of their bytes, and a reader of folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.pdf import pages_of
from ..session import importable

PAGES = "page_no int, width double, height double, text string, tables array<array<array<string>>>, problem string"
#: Pages that are handed on at once.
HELD = 256


class PdfPages:
    """A row for each page of a file; a file that can't be read, or from the page on that can't be, is one row whose ``problem`` says why."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        number = 0
        try:
            for number, width, height, text, tables in pages_of(bytes(content or b"")):
                yield number, width, height, text, tables, None
        except (ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError) as e:  # damage of any kind belongs to its file
            yield number + 1, None, None, None, None, f"{type(e).__name__}: {e}"


def register_functions(spark: SparkSession) -> None:
    """``pdf_pages(content)`` for lateral joins in SQL."""
    importable(spark)
    spark.udtf.register("pdf_pages", F.udtf(PdfPages, returnType=PAGES))


def pages(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The pages of files such as ``binaryFile`` gives: ``path, page_no, width, height, text, tables, problem``."""
    importable(files.sparkSession)
    named = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    schema = StructType([named.schema["path"], *StructType.fromDDL(PAGES)])
    return named.mapInArrow(lambda batches: _read(batches, to_arrow_schema(schema)), schema)


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of PdfPages for each file, in batches of some hundred pages."""
    reader, held = PdfPages(), []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for row in reader.eval(content.as_py()):
                held.append((path.as_py(), *row))
                if len(held) >= HELD:
                    yield _batch(held, schema)
                    held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The pages of all files below a folder; Spark has no row for a file without a byte."""
    return pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path))


def tables(page_rows: DataFrame) -> DataFrame:
    """``path, page_no, text, table_no, rows``: the tables of pages, as the parsers of tables take them."""
    return page_rows.select("path", "page_no", "text", F.posexplode("tables").alias("table_no", "rows"))
