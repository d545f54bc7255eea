"""Raw text tables: cutting, header search, unpivoting to records, grids of OCR blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lanes import LABEL, lane_of, lane_tokens
from ..functions.scalars import extract_step, parse_salary


def trimmed(rows: Column) -> Column:
    """Ragged rows of cells as trimmed strings; null cells are empty."""
    return F.transform(rows, lambda row: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit(""))))


def has_structure(rows: Column) -> Column:
    """A STEP cell and a cell with an education token among the first five rows, on one row."""
    return F.exists(F.slice(rows, 1, 5), lambda row: F.exists(row, lambda c: F.upper(c).contains("STEP")) & F.exists(row, lambda c: F.upper(c).rlike("B|M|DOC|CAGS")))


def split_on_steps(tables: DataFrame) -> DataFrame:
    """Cuts tables side by side at each column headed STEP: ``table_no`` counts the parts."""
    header = F.col("rows")[0]
    places = F.filter(F.transform(header, lambda c, i: F.when(F.upper(F.trim(c)) == "STEP", i)), lambda i: i.isNotNull())
    kept = tables.withColumn("places", places)
    whole = (F.size("places") == 0) | ((F.size("places") == 1) & (F.col("places")[0] == 0))
    begins = F.when(whole, F.array(F.lit(0))).otherwise(F.col("places"))
    parts = kept.withColumn("begins", begins).select(*tables.columns, "begins", F.posexplode("begins").alias("part", "begin"))
    end = F.coalesce(F.try_element_at("begins", F.col("part") + 2), F.size(F.col("rows")[0]))
    width = end - F.col("begin")
    cut = F.transform("rows", lambda row: F.transform(F.sequence(F.col("begin"), F.col("begin") + width - 1), lambda i: F.coalesce(F.get(row, i), F.lit(""))))
    return parts.select(*[c for c in tables.columns if c != "rows"], "part", cut.alias("rows"))


def _resolved(labels: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``labels`` (doc_id, label, ...) with ``lane``: what a document's own alias says, else what the label itself stands for."""
    if aliases is None:
        return labels.withColumn("lane", lane_of(F.col("label")))
    own = aliases.select("doc_id", alias_name(F.col("alias")).alias("__alias"), F.col("lane").alias("__text"))
    joined = labels.withColumn("__alias", alias_name(F.col("label"))).join(own, ["doc_id", "__alias"], "left")
    return joined.withColumn("lane", lane_of(F.coalesce("__text", "label"))).drop("__alias", "__text")


def alias_name(label: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(label)), r"\s+", "")


def to_records(tables: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Records of tables whose first row is the header and first column the step.

    Each row is unpivoted against the header by place. A label stands for the lane that an
    alias of its document names (``aliases``: doc_id, alias, lane), else for its own; unknown
    labels and values out of range are dropped.
    """
    columns = tables.select("doc_id", "rows", F.posexplode(F.col("rows")[0]).alias("col_no", "label")).filter("col_no > 0")
    values = F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda row: F.struct(F.get(row, F.lit(0)).alias("step_text"), F.get(row, F.col("col_no")).alias("value")))
    # a label's lane is found once a column, not once a cell
    labels = _resolved(columns.select("doc_id", "col_no", F.upper(F.trim("label")).alias("label"), values.alias("values")), aliases).filter("lane IS NOT NULL")
    cells = labels.select("doc_id", "lane", "col_no", F.posexplode("values").alias("row_no", "cell"))
    parsed = cells.select("doc_id", "lane", "row_no", "col_no", extract_step(F.col("cell.step_text")).alias("step"), parse_salary(F.col("cell.value")).alias("salary"))
    return parsed.filter("step IS NOT NULL AND salary IS NOT NULL").select("doc_id", "lane.education", "lane.credits", "step", "salary", F.struct("row_no", "col_no").alias("pos"))


def block_grids(blocks: DataFrame, least_cells: int = 10) -> DataFrame:
    """Rows of cells from OCR blocks: a table's cells, and each cell's words, by their relationships.

    Blocks are joined on their ids, words put in order, and cells placed by row and column;
    tables of fewer cells are dropped.
    """
    child = blocks.select("Id", "BlockType", "RowIndex", "ColumnIndex", F.explode("Relationships").alias("r")).filter("r.Type = 'CHILD'").select(F.col("Id").alias("parent"), "BlockType", "RowIndex", "ColumnIndex", F.posexplode("r.Ids").alias("pos", "child"))
    words = blocks.filter("BlockType IN ('WORD', 'LINE')").select(F.col("Id").alias("child"), "Text")
    text = child.filter("BlockType = 'CELL'").join(words, "child").groupBy("parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "Text"))), lambda x: x["Text"]), " ").alias("text"))
    cells = blocks.filter("BlockType = 'CELL'").select(F.col("Id").alias("child"), "RowIndex", "ColumnIndex").join(text.withColumnRenamed("parent", "child"), "child", "left")
    placed = child.filter("BlockType = 'TABLE'").select(F.col("parent").alias("table_id"), "child").join(cells, "child")
    # a table's cells are brought together once: they are bounded, and what follows needs no other shuffle
    held = placed.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.max("ColumnIndex").alias("width"), F.collect_list(F.struct("RowIndex", "ColumnIndex", F.coalesce(F.trim("text"), F.lit("")).alias("text"))).alias("cells"))
    sized = held.filter(F.col("n") >= least_cells).select("table_id", "width", F.inline("cells"))
    rows = sized.groupBy("table_id", "width", "RowIndex").agg(F.map_from_entries(F.collect_list(F.struct("ColumnIndex", "text"))).alias("at"))
    full = rows.withColumn("row", F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.element_at(F.col("at"), i), F.lit(""))))
    return full.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("RowIndex", "row"))), lambda x: x["row"]).alias("rows"))


def deduped_headers(headers: DataFrame) -> DataFrame:
    """Repeated labels of a header get _1, _2 and so on: ``table_id, pos, label``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("table_id", "label").orderBy("pos")) - 1
    return headers.withColumn("n", n).select("table_id", "pos", F.when(F.col("n") > 0, F.concat_ws("_", "label", F.col("n").cast("string"))).otherwise(F.col("label")).alias("label"))


def without_multipliers(rows: Column) -> Column:
    """Of header pairs MULTIPLIER and salary only the salary columns stay, in all rows."""
    header = F.transform(rows[0], lambda c: F.upper(F.trim(c)))
    return F.transform(rows, lambda row: F.filter(row, lambda c, i: ~F.coalesce(F.get(header, i).contains("MULTIPLIER"), F.lit(False))))


def alias_pairs(docs: DataFrame) -> DataFrame:
    """Alias lines of texts, ``NAME = LANE`` or with a colon or dash, as ``doc_id, alias, lane``; the first definition counts.

    The lane is the first that is named behind the sign; a name that is a lane itself is no alias.
    """
    from pyspark.sql import Window

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pattern = r"(?i)^\s*([A-Z][A-Z0-9 ]*?)\s*(?:=|:|\s[-–—])\s*(.+?)\s*$"
    parts = lines.filter(F.col("line").rlike(pattern)).select("doc_id", "pos", F.upper(F.regexp_extract("line", pattern, 1)).alias("alias"), F.regexp_extract("line", pattern, 2).alias("text"))
    named = parts.select("doc_id", "pos", "alias", F.get(lane_tokens(F.col("text")), F.lit(0)).alias("lane"), F.col("alias").rlike(f"^(?:{LABEL})$").alias("own")).filter("lane IS NOT NULL AND NOT own")
    first = Window.partitionBy("doc_id", "alias").orderBy("pos")
    return named.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", "alias", "lane")


def is_text(pages: DataFrame, first: int = 3, least: int = 100) -> DataFrame:
    """Whether documents are text and not images: enough characters on their first pages."""
    length = F.sum(F.when(F.col("page_no") <= first, F.length(F.trim("text"))))
    return pages.groupBy("doc_id").agg((F.coalesce(length, F.lit(0)) > least).alias("is_text"))


def table_year(first_cell: Column, page_year: Column) -> Column:
    """A year named in a table's first cell, else the page's; two digits alone are a step, not a year."""
    from ..functions.scalars import UNKNOWN, school_year

    return F.coalesce(F.nullif(school_year(first_cell, two_digits=False), F.lit(UNKNOWN)), page_year)


def unmapped_labels(tables: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Header labels that stand for no lane, ``doc_id, pos, label``: what to_records leaves out, for a reviewer."""
    labels = tables.select("doc_id", F.posexplode(F.col("rows")[0]).alias("pos", "label")).filter("pos > 0").withColumn("label", F.upper(F.trim("label")))
    return _resolved(labels.filter("label <> ''"), aliases).filter("lane IS NULL").select("doc_id", "pos", "label")


# What a label held to count as one of a lane, in the older reading.
OLDER_KEYS = ("BA", "MA", "DOC", "CAGS", "B+", "M+")
OLDER_STEPS = 20


def older_cells(tables: DataFrame) -> DataFrame:
    """``doc_id, label, step, salary`` as the older reading had them, for results that must agree with it.

    Labels are kept if they hold one of a few letters, without blanks and in capitals; all
    others are dropped before values are matched to labels by place, so that behind a dropped one each
    value stands under the label before its own. ``to_records`` matches by the column itself.
    """
    bare = F.transform(F.col("rows")[0], lambda c: F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("")))
    holds = lambda c: F.exists(F.array(*map(F.lit, OLDER_KEYS)), lambda k: c.contains(k))
    labels = F.filter(bare, lambda c: ~c.isin("", "STEP", "STEPS") & holds(c))
    rows = tables.select("doc_id", labels.alias("labels"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row_no", "row"))
    cells = rows.select("doc_id", extract_step(F.col("row")[0]).alias("step"), "row", F.posexplode("labels").alias("k", "label"))
    found = cells.select("doc_id", "label", "step", parse_salary(F.get("row", F.col("k") + 1)).alias("salary"))
    return found.filter((F.col("step").between(1, OLDER_STEPS)) & F.col("salary").isNotNull())
