"""Sources and sinks: CSV, Excel where pandas can read it, several files at once, reports, models, previews."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.linkage import merge_files
from ..operators.profile import coerce_types, normalize_names


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Header names are trimmed; types are inferred unless a schema is given, which saves a pass."""
    reader = spark.read.option("header", True).options(**options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet, by pandas on the driver, as the format can't be split; needs an Excel reader for pandas."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("pandas has no reader for Excel files here") from e
    frame.columns = [str(c).strip() for c in frame.columns]
    return spark.createDataFrame(frame)


def read_auxiliary(spark: SparkSession, path: str) -> DataFrame:
    """S3: an empty table is refused."""
    df = read_excel(spark, path) if path.endswith((".xlsx", ".xls")) else read_csv(spark, path)
    if df.isEmpty():
        raise ValueError("the auxiliary table is empty")
    return df


def read_merged(spark: SparkSession, paths: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each file with normalised names and types read from its text columns, merged adaptively."""
    return merge_files([coerce_types(normalize_names(read_csv(spark, p))[0]) for p in paths], keys)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet between stages, CSV with a header for download."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table as JSON lines or CSV; ``report_text`` makes Markdown of a small one."""
    write_table(df, path, kind)


def report_text(title: str, content: dict) -> str:
    """Markdown of a nested report."""
    lines = [f"# {title}", ""]
    for k, v in content.items():
        lines += [f"## {k}", "", "```json", json.dumps(v, indent=1, default=str, sort_keys=True), "```", ""]
    return "\n".join(lines)


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of a stated order."""
    return df.orderBy(*order).limit(n)


def load_codebook(path: str) -> dict[str, dict[str, str]]:
    """U20."""
    with open(path) as f:
        return json.load(f)
