"""Sinks: declared fields as CSV or Parquet, dictionaries as JSON, rows in an HTML page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The declared fields as strings, days as ISO, missing fields and nulls empty, booleans yes or no."""

    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        kind = df.schema[name].dataType.simpleString()
        value = F.when(F.col(name), "yes").otherwise("no") if kind == "boolean" else F.col(name).cast("string")
        return F.when(F.col(name).isNull(), "").otherwise(value).alias(name)

    return df.select(*map(one, fields))


def write_csv(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str] = (), one_file: bool = False) -> None:
    """A CSV export; with ``one_file`` in a single part, for tables that people read."""
    out = as_text(df.orderBy(*order) if order else df, fields)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, fields: Sequence[str], by: Sequence[str] = ()) -> None:
    w = df.select(*fields).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def dictionary_json(people: DataFrame) -> DataFrame:
    """One JSON object per person, in order of names: aliases always, other fields where they are not empty."""
    full = F.struct(*(F.when(F.col(c).isNotNull() & (F.size(c) > 0), F.col(c)).alias(c) if "array" in dict(people.dtypes)[c] and c != "aliases" else F.nullif(F.col(c), F.lit("")).alias(c) if c != "aliases" else F.coalesce("aliases", F.array().cast("array<string>")).alias(c) for c in people.columns if c != "person"))
    return people.select("person", F.to_json(full).alias("json")).orderBy("person")


def review_queue(df: DataFrame, label: str, labels: Sequence[str], blanks: Sequence[str]) -> DataFrame:
    """Rows to review: those of the given labels, with blank columns for the reviewer."""
    return df.filter(F.col(label).isin(list(labels))).select("*", *(F.lit("").alias(b) for b in blanks))


def hard_negatives(df: DataFrame, span: str, proposals: DataFrame) -> DataFrame:
    """Rows whose span is one of the listed forms (form, proposed), a list small enough to broadcast."""
    return df.join(F.broadcast(proposals.select(F.lower("form").alias("_f"), "proposed")), F.lower(F.col(span)) == F.col("_f")).drop("_f")


def html_page(rows: DataFrame, template: str, mark: str = "__DATA__") -> str:
    """A page with the rows as JSON in place of ``mark``; for reduced tables, as the rows come to the driver."""
    data = "[" + ",".join(r.j for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()) + "]"
    return template.replace(mark, data.replace("</", "<\\/"))
