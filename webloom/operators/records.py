"""What is done with results: documents for retrieval, chunks, rolling buffers, tables that sort numbers as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def documents(records: DataFrame, text: str = "text") -> DataFrame:
    """page_content and metadata (map): the text of each record, its other columns as metadata; without a text the whole record as JSON."""
    rest = [c for c in records.columns if c != text]
    everything = F.to_json(F.struct(*records.columns))
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    content = F.coalesce(F.col(text), everything) if text in records.columns else everything
    return records.select(content.alias("page_content"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))


def chunks(docs: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """docs with chunk_no and chunk instead of text: pieces of size characters, each sharing overlap with the one before. An empty text has none."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - F.lit(overlap + 1)), F.lit(step)))
    cut = docs.select("*", F.posexplode(starts).alias("chunk_no", "_at"))
    return cut.withColumn("chunk", F.substring(F.col(text), F.col("_at") + 1, F.lit(size))).drop("_at", text)


def rolling_latest(rows: DataFrame, key: str, at: str, capacity: int = 100) -> DataFrame:
    """The latest row of each key, and of these the latest `capacity` (ties go to the lesser key)."""
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(at)).alias("_row"))
    return latest.select(key, "_row.*").orderBy(F.col(at).desc(), F.col(key)).limit(capacity).select(rows.columns)


def numeric_order(c: Column) -> list[Column]:
    """Sort keys of a text column: what reads as a number first, by value, then the rest as text, null as empty."""
    number = F.expr("try_cast({} as double)".format("c")) if isinstance(c, str) else c.try_cast("double")
    return [number.isNull().asc(), number.asc(), F.coalesce(c, F.lit("")).asc()]


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with each row's place (from 1) in an order, found from the sizes of sorted partitions: no partition holds all rows."""
    ranged = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return ranged.join(offsets, part == F.col("_part")).withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("int")).select(*df.columns, name)


def sorted_by(df: DataFrame, column: str, again: str | None = None) -> DataFrame:
    """df by a column, numbers as numbers; the order turns round when that column was the last one (again) too."""
    keys = numeric_order(F.col(column).cast("string"))
    return df.orderBy(*(keys if again != column else [F.col(column).cast("string").try_cast("double").isNull().desc(), F.col(column).cast("string").try_cast("double").desc(), F.coalesce(F.col(column).cast("string"), F.lit("")).desc()]))


def is_numeric(values: list[str | None]) -> bool:
    """Whether a column whose first cells these are is sorted as numbers: of the first ten that aren't empty half are."""
    some = [v for v in values if v not in (None, "")][:10]

    def number(v: str) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    n = sum(map(number, some))
    return n > 0 and 2 * n >= len(some)


def preview(c: Column, most: int = 300) -> Column:
    return F.substring(c, 1, most)


def first_items(c: Column, most: int = 10) -> Column:
    return F.slice(c, 1, most)


def row_numbers(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def write_ndjson(df: DataFrame, path: str) -> None:
    """Appends results as JSON lines; nothing is dropped."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Results with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(flat).write.option("header", True).csv(path)


def write_json_cells(df: DataFrame, path: str) -> None:
    """Results as JSON, each cell as text."""
    df.select([F.col(c).cast("string") for c in df.columns]).write.json(path)
