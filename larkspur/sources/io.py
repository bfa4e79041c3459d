"""Readers and writers at the edges: CSV, text, JSON and file listings in; Parquet and small reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def read_table(spark: SparkSession, path: str, schema: str | StructType, encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """A headed CSV table with a declared schema; NaN and empty fields are null."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, encoding=encoding, sep=sep, nanValue="nan"))


def read_splits(spark: SparkSession, root: str, splits: list[str], captions: StructType | str, metadata: StructType | str, key: str = "file_name") -> DataFrame:
    """Captions joined with metadata (Latin-1) per split, stacked, with the split's name."""
    parts = [read_table(spark, f"{root}/captions_{s}.csv", captions).join(read_table(spark, f"{root}/metadata_{s}.csv", metadata, "ISO-8859-1"), key).withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def loose(raw: DataFrame, casts: dict[str, str], aliases: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """All-string rows cast field by field: (rows where every cast worked, the rejected rows as read)."""
    for name, options in (aliases or {}).items():
        raw = raw.withColumn(name, F.coalesce(*(F.col(o) for o in options if o in raw.columns)))
    ok = F.lit(True)
    for c, t in casts.items():
        ok = ok & F.col(c).try_cast(t).isNotNull() & ~F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))
    good = raw.where(ok)
    for c, t in casts.items():
        good = good.withColumn(c, F.col(c).try_cast(t))
    return good, raw.where(~ok)


def read_loose(spark: SparkSession, path: str, columns: list[str], casts: dict[str, str], aliases: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    return loose(spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path, header=True), casts, aliases)


def index_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """key (name before the first dot) and path: system files dropped, the shortest name of a key kept, then the first path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = listing.where(~F.col(path).contains("__MACOSX") & ~name.startswith("._")).select(F.substring_index(name, ".", 1).alias("key"), F.col(path).alias("path"), F.length(name).alias("n"))
    return rows.groupBy("key").agg(F.min(F.struct("n", "path"))["path"].alias("path"))


def file_index(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    return index_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path"))


def parse_lines(text: DataFrame, col: str = "value", comment: str = "#") -> DataFrame:
    """A whole text per row -> line_no, id, grp, item of `id|group|item` lines; other lines get promptNN by line number."""
    rows = text.select(F.posexplode(F.split(col, r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith(comment))
    parts = F.split("line", r"\|")
    full = F.size(parts) == 3
    no = F.col("pos") + 1
    return rows.select(no.alias("line_no"), F.when(full,
        F.trim(parts[0])).otherwise(F.concat(F.lit("prompt"), F.when(no < 10, "0").otherwise(""), no.cast("string"))).alias("id"),
            F.when(full, F.trim(parts[1])).alias("grp"), F.when(full, F.trim(parts[2])).otherwise(F.col("line")).alias("item"))


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return parse_lines(spark.read.text(path, wholetext=True), "value", comment)


def zip_lines(texts: dict[str, DataFrame], col: str = "value") -> DataFrame:
    """Texts of equal length joined by line number; raises where the lengths differ."""
    out = None
    for name, t in texts.items():
        rows = t.select(F.posexplode(F.split(F.regexp_replace(col, r"\n$", ""), r"\r?\n")).alias("line_no", name))
        out = rows if out is None else out.join(rows, "line_no", "full")
    same = F.lit(True)
    for name in texts:
        same = same & F.col(name).isNotNull()
    return out.withColumn("line_no", F.when(same, F.col("line_no")).otherwise(F.raise_error(F.lit("texts differ in length")).cast("int")))


def read_json_dir(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One record a file, with its path; unreadable files have _corrupt_record."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").json(root, multiLine=True, recursiveFileLookup=True, mode="PERMISSIVE")
    return df.withColumn("path", F.col("_metadata.file_path"))


def pair_sidecars(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """audio (path) and texts (path, value): bin, stem, file and caption of files that lie side by side."""
    split = lambda d: d.withColumn("bin", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return split(audio).join(split(texts).select("bin", "stem", F.trim("value").alias("caption")), ["bin", "stem"]).select("bin", "stem", F.col("path").alias("file"), "caption")


def write_manifest(df: DataFrame, out: str, side_tables: dict[str, DataFrame] | None = None, config: dict | None = None) -> None:
    """The manifest and its side tables as Parquet, the configuration as JSON; a target that exists is refused."""
    df.write.mode("errorifexists").parquet(f"{out}/metadata")
    for name, t in (side_tables or {}).items():
        t.write.mode("errorifexists").parquet(f"{out}/{name}")
    if config is not None:
        import json

        df.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{out}/config")


def write_report(df: DataFrame, out: str, order: list[str], sep: str = ",", index: str | None = None) -> None:
    """A small ordered report as one CSV or TSV file, with a row number where asked for."""
    if index:
        df = df.withColumn(index, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    df.orderBy(*order).coalesce(1).write.csv(out, header=True, sep=sep)


def write_playlist(df: DataFrame, out: str, line: Column, order: list[str]) -> None:
    df.orderBy(*order).select(line.alias("value")).coalesce(1).write.text(out)


def refresh_columns(base: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """base with `cols` replaced by new's."""
    return base.drop(*cols).join(new.select(*keys, *cols), keys, "left")


def upsert(base: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """One row of each key from both tables, the last one: that with the largest version, if there is such a column, else
    new's before base's. Of rows that are alike in that new's come before base's, and then the largest row by the other
    columns, so that the same rows always give the same result."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc_nulls_last(version)] if version else []
    rest = [F.desc_nulls_last(c) for c in base.columns if c not in key and c != version]
    w = Window.partitionBy(*key).orderBy(*order, F.desc("_new"), *rest)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def pending(todo: DataFrame, done: DataFrame, key: list[str], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of todo that aren't done; with groups of columns, also need_<group> where done lacks one of them."""
    if not groups:
        return todo.join(done, key, "left_anti")
    need = {g: F.exists(F.array(*map(F.col, cols)), lambda x: x.isNull()) for g, cols in groups.items()}
    out = todo.select(*key).join(done, key, "left").select(*key, *(c.alias(f"need_{g}") for g, c in need.items()))
    any_ = F.lit(False)
    for g in groups:
        any_ = any_ | F.col(f"need_{g}")
    return out.where(any_)


def split_errors(df: DataFrame, result: str = "result", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one) of a single pass's struct of both."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).drop(result)
