"""Class rosters: semicolon-separated, headers in any case, two columns required."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.functions.text import strip

REQUIRED = ("vorname", "nachname")
COLUMNS = (*REQUIRED, "pronomen")


def _header(names: list[str]) -> list[str]:
    cleaned = [n.strip().lower() for n in names]
    missing = [c for c in REQUIRED if c not in cleaned]
    if missing:
        raise ValueError(f"roster header lacks {', '.join(missing)}")
    return cleaned


def _complete(rows: DataFrame) -> DataFrame:
    if "pronomen" not in rows.columns:
        rows = rows.withColumn("pronomen", F.lit(None).cast("string"))
    for name in (*REQUIRED, "pronomen"):
        rows = rows.withColumn(name, strip(F.coalesce(name, F.lit(""))))
    return rows.filter((F.col("vorname") != "") & (F.col("nachname") != ""))


# columns that a roster may have; cells behind the last one are not read
MOST_COLUMNS = 64
_CELLS = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS))


def _array(parsed: str) -> Column:
    return F.array(*[F.col(f"{parsed}.c{i}") for i in range(MOST_COLUMNS)])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line, vorname, nachname, pronomen, header): the lines of every file, their
    cells named by the file's own header; ``header`` is whether it has the required columns.

    Lines are parsed inside their file, once each; a cell is then looked up by the place that
    the header gives its column. Of a column named twice the first counts.
    """
    csv = lambda line: F.from_csv(line, _CELLS, {"sep": ";", "mode": "PERMISSIVE"})
    lines = F.split(F.regexp_replace("value", r"\A\uFEFF", ""), r"\r\n|\r|\n")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), lines.alias("_lines")).withColumn("_head", csv(F.col("_lines")[0]))
    names = F.transform(_array("_head"), lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    places = whole.select("path", "_lines", *[F.nullif(F.array_position(names, n), F.lit(0)).cast("int").alias(f"_{n}") for n in COLUMNS])
    parsed = F.transform(F.slice("_lines", F.lit(2), F.size("_lines")), lambda line, i: F.struct((i + 1).alias("pos"), line.alias("line"), csv(line).alias("cells")))
    rows = places.select("path", *[f"_{n}" for n in COLUMNS], F.inline_outer(parsed))
    required = reduce(Column.__and__, [F.col(f"_{n}").isNotNull() for n in REQUIRED])
    return rows.select("path", "pos", "line", *[F.get(_array("cells"), F.col(f"_{n}") - 1).alias(n) for n in COLUMNS], required.alias("header"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(vorname, nachname, pronomen) of all files below a path, each by its own header line.

    One scan, whatever the number of headers: a line's cells are named by the header of its
    file. A file without the required columns is an error.
    """
    files = read_files(spark, path)
    lacking = files.filter("not header").select("path").limit(1).collect()
    if lacking or files.isEmpty():
        raise ValueError(f"roster header lacks {' or '.join(REQUIRED)}: {lacking[0][0]}" if lacking else f"no roster at {path}")
    return _complete(files.filter(strip(F.coalesce("line", F.lit(""))) != "").select(*COLUMNS))


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, reason) of what ``read_roster`` would not take."""
    files = read_files(spark, path)
    bare = lambda n: strip(F.coalesce(n, F.lit(""))) == ""
    reason = F.when(~F.col("header"), "header").when(bare(REQUIRED[0]) | bare(REQUIRED[1]), "name")
    filled = files.filter(strip(F.coalesce("line", F.lit(""))) != "")
    return filled.select("path", (F.col("pos") + 1).alias("line"), reason.alias("reason")).filter("reason is not null")


def parse_lines(lines: DataFrame, header: str) -> DataFrame:
    """The same for a table whose ``value`` column holds the lines below a known header."""
    names = _header(header.split(";"))
    schema = ", ".join(f"`{n}` string" for n in names)
    keep = [c for c in lines.columns if c != "value"]
    return _complete(lines.select(*keep, F.from_csv("value", schema, {"sep": ";"}).alias("r")).select(*keep, "r.*"))
