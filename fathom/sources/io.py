"""Reading and writing the store: task documents, append logs, exports, imports, corpora of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that a walk leaves out.
SKIPPED = ["node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor"]


def read_task_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON document {"items": [...]}. A document that isn't JSON gives no rows."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    rows = spark.read.schema(f"items array<{kind}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.explode("items").alias("item")).select("item.*")


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the older ones, as JSON lines; readers of an older one aren't disturbed."""
    where = f"{path}/v{version:08d}"
    df.write.mode("errorifexists").json(where)
    return where


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines) of a JSON-lines log."""
    fields = schema.simpleString().removeprefix("struct<").removesuffix(">") if isinstance(schema, T.StructType) else schema
    parsed = F.from_json("value", f"{fields}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.where("_broken IS NULL").drop("_broken"), rows.where("_broken IS NOT NULL").select("_broken")


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """json, parquet, or csv with a header, in which nested fields become JSON strings."""
    if kind == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])
        df.write.option("header", True).option("escape", '"').csv(path)
    else:
        df.write.format(kind).save(path)


def corpus_files(spark: SparkSession, path: str, extensions: list[str], most: int | None = None) -> DataFrame:
    """(path, mtime, size, content) of the files with these extensions, hidden and skipped folders left out, in order of the path.

    Without content asked for, only the listing is read. `most` is a cap that callers ask for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    left_out = "|".join([r"/\.[^/]+/", *[f"/{s}/" for s in SKIPPED]])
    rows = files.where(~F.col("path").rlike(left_out)).select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.orderBy("path").limit(most) if most else rows


def keyword_lines(spark: SparkSession, path: str, words: list[str], glob: str = "*.md", top: int = 20) -> DataFrame:
    """Lines that hold the most of the words: (file, line, score)."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    score = sum((F.lower("line").contains(w.lower()).cast("int") for w in words), F.lit(0))
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "file", "line").limit(top)


def census(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of each table, counted in one job."""
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    first = out[0]
    for df in out[1:]:
        first = first.unionByName(df)
    return first


def first_enough(providers: list[DataFrame], least: int) -> DataFrame:
    """Results of the providers in turn, until there are `least` rows."""
    out = providers[0]
    for more in providers[1:]:
        if out.limit(least).count() >= least:
            break
        out = out.unionByName(more)
    return out
