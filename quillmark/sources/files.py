"""Ledger files, snapshots, file trees and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a missing file has no rows. strict: a
    malformed line fails; otherwise such lines are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """row (parsed, null if malformed), line (from 1) and raw text of one file's lines. A file
    is read whole, as its line numbers need; ledgers are read by `jsonl`."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("_p", "raw")).where(F.length(F.trim("raw")) > 0)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select((F.col("_p") + 1).alias("line"), "raw", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", kind)).alias("row"))


META = "url string, final_url string, http_status int, mime string, is_pdf boolean, sha256 string, accessed_at string, title string, raw string, clean string, status string, fetch_ref string"


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One row per lookup of each stored snapshot: META of the lookup, sha12 and accessed_at;
    snapshots without a meta file come from their file names."""
    shape = T.StructType([*T._parse_datatype_string(META).fields, T.StructField("urls", T.ArrayType(T._parse_datatype_string(META)))])
    meta = spark.read.schema(shape).option("multiLine", True).json(f"{folder}/*.meta.json") if _exists(spark, f"{folder}/*.meta.json") else spark.createDataFrame([], shape)
    names = [f.name for f in T._parse_datatype_string(META).fields]
    look = meta.select("*", F.explode_outer("urls").alias("u"))
    known = look.select(*[F.coalesce(F.col(f"u.{n}"), F.col(n)).alias(n) for n in names]).withColumn("sha12", F.substring("sha256", 1, 12))
    if not _exists(spark, f"{folder}/*_raw.*"):
        return known
    files = spark.read.format("binaryFile").load(f"{folder}/*_raw.*").select("path")
    sha = F.regexp_extract("path", r"([0-9a-f]{12})_raw\.[^/]*$", 1)
    bare = files.select(sha.alias("sha12"), F.col("path").alias("raw")).where("sha12 <> ''").join(known.select("sha12"), "sha12", "left_anti")
    return known.unionByName(bare, allowMissingColumns=True)


def source_rows(lookups: DataFrame, clean: DataFrame) -> DataFrame:
    """Numbered source list: n, title, publisher, url, sha12, accessed_at, excerpt. clean:
    sha12, text."""
    from pyspark.sql import Window

    from quillmark.functions.text import excerpt
    from quillmark.functions.urls import publisher

    url = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    rows = lookups.join(clean, "sha12", "left").select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), url).alias("title"), publisher(url).alias("publisher"), url.alias("url"), "sha12", "accessed_at", excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.coalesce("accessed_at", F.lit("")), "sha12", "url")
    return rows.select(F.row_number().over(order).alias("n"), "*")


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """key, text of the clean text files; invalid UTF-8 is replaced, form feeds stay."""
    if not _exists(spark, f"{folder}/*_clean.*"):
        return spark.createDataFrame([], "key string, text string")
    rows = spark.read.format("binaryFile").load(f"{folder}/*_clean.*")
    return rows.select(F.regexp_extract("path", r"([^/]+)_clean\.[^/]*$", 1).alias("key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


# What lies where in a work folder.
LABELS = {r"^facts\.jsonl$": "facts", r"^evidence\.jsonl$": "evidence", r"^report\.md$": "report", r"^_sources/": "source", r"^_captures/": "capture", r"^_images/": "image", r"^assets/": "asset", r"^audit/": "audit"}


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), label, sha256, size of the tracked files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    path = F.regexp_replace("path", rf"^[a-z0-9]+:/*(?=/)|^.*?{base}/", "")
    path = F.regexp_replace(F.col("path"), rf"^.*?\Q{base}\E/", "") if base else path
    label: Column = F.lit(None).cast("string")
    for pattern, name in reversed(LABELS.items()):
        label = F.when(path.rlike(pattern), F.lit(name)).otherwise(label)
    return files.select(path.alias("path"), label.alias("label"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).where("label is not null")


def config(spark: SparkSession, path: str) -> dict:
    """A JSON document as a dictionary."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# First bytes of image files.
MAGIC = {"png": "89504E47", "jpg": "FFD8FF", "gif": "47494638", "webp": "52494646", "pdf": "25504446", "zip": "504B0304"}


def media_kind(content: Column) -> Column:
    """Kind of a file by its first bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def valid_download(content: Column, status: Column, least: int = 2_000, most: int = 15 << 20) -> Column:
    size = F.octet_length(content)
    return F.coalesce(status.between(200, 299) & size.between(least, most) & media_kind(content).isin("png", "jpg", "gif", "webp"), F.lit(False))


def overwrite(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replaces a dataset as a whole: written beside it, then renamed, so a reader never sees
    half of it and a failed write leaves the old one."""
    import uuid

    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.format(format).save(new)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    had = fs.exists(fs_path(path))
    if had and not fs.rename(fs_path(path), fs_path(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(fs_path(new), fs_path(path)):
        if had:
            fs.rename(fs_path(old), fs_path(path))
        raise OSError(f"can't put {path}")
    if had:
        fs.delete(fs_path(old), True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_all(tables: dict[str, DataFrame], root: str) -> str:
    """Several datasets as one version: all are written below root/versions/<id>, then
    root/current names it. Readers use `current_version`; a failed write changes nothing."""
    import uuid

    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{root}/versions/{name}/{table}")
    spark = next(iter(tables.values())).sparkSession
    overwrite(spark.createDataFrame([(name,)], "version string").coalesce(1), f"{root}/current")
    return name


def current_version(spark: SparkSession, root: str) -> str:
    return f"{root}/versions/{spark.read.parquet(f'{root}/current').first()[0]}"


def markdown_table(df: DataFrame, *columns: str) -> DataFrame:
    """line: rows as markdown table lines, cells escaped."""
    from quillmark.functions.text import cell_escape

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell_escape(F.col(c).cast("string")) for c in columns]), F.lit(" |")).alias("line"))


def saved_blobs(lookups: DataFrame) -> DataFrame:
    """sha256, lookups: every address a blob was fetched from, in order of time."""
    rest = [c for c in lookups.columns if c != "sha256"]
    return lookups.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("accessed_at", *[c for c in rest if c != "accessed_at"]))).alias("lookups"))
