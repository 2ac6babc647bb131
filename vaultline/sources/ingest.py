"""File loads (COPY INTO) by column name, with a schema check and a stored log.

The reference only simulates loads (a fixed answer of 1245 rows). Here a
load takes CSV / JSON / PARQUET files, maps their columns to the target's by
name, parses every file once into a staging table, logs each file from it,
and appends the good rows of the accepted files to the target.

A file is refused as a whole when its columns are not the target's:

* CSV with a header line: another set of names (any order is fine). The
  header is the last of the ``skip_header`` lines; without one
  (``skip_header=0``) columns go by position.
* JSON: a key the target lacks, in any row (keys of all rows are checked in
  the pass that parses them). A missing key is NULL.
* PARQUET: a column the target lacks, from the file's footer. One job merges
  the footers of all files; only where that finds an issue are they halved.
* CSV with a quoted field that spans lines, unless ``multi_line`` is set (the
  file is then parsed whole by one task).

Rows that do not parse under the target's types are counted as errors.

``copy_into`` loads a file once: files that the history has as loaded with the
same path, length and time are left out, unless ``force`` is set. A load writes
its rows to a folder of its own and then its log; the log is the commit. Rows
of a load that died before it are never read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..streaming.deltas import hadoop_path

CORRUPT = "_corrupt_record"
SPANS = "a quoted field spans lines"
FORMATS = ("CSV", "JSON", "PARQUET")
HEADS_AT_ONCE = 16  # folders, header lines and groups of footers that are read at a time
LOG = T.StructType([T.StructField(name, kind, True) for name, kind in (
    ("file_name", T.StringType()), ("file_format", T.StringType()), ("stage", T.StringType()), ("status", T.StringType()),
    ("rows_loaded", T.LongType()), ("errors", T.LongType()), ("message", T.StringType()), ("load_id", T.StringType()),
    ("loaded_at", T.TimestampNTZType()), ("fingerprint", T.StringType()))])


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(data file, fingerprint) under ``path``; the driver lists names, it
    reads none. The fingerprint is the file's path, length and time."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    it = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while it.hasNext():
        status = it.next()
        f = status.getPath()
        if f.getName()[:1] not in ("_", "."):
            out.append((f.toString(), f"{f.toString()}|{status.getLen()}|{status.getModificationTime()}"))
    return sorted(out)


def first_lines(spark: SparkSession, file: str, n: int) -> list[str]:
    """The first ``n`` lines of a text file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        lines = [reader.readLine() for _ in range(n)]
    finally:
        reader.close()
    return [x for x in lines if x is not None]


def _header(spark: SparkSession, line: str) -> list[str]:
    """Column names of a header line, by Spark's own CSV reader."""
    row = spark.read.csv(spark.sparkContext.parallelize([line], 1)).first()
    return [(v or "").strip() for v in row]


def schema_issue(columns: list[str], target: T.StructType, whole: bool) -> str | None:
    """Why a file with these columns is refused (None: it is not)."""
    wanted, have = [f.name.lower() for f in target.fields], [c.lower() for c in columns]
    issues = [f"field {c} not found in destination" for c, low in zip(columns, have, strict=True) if low not in wanted]
    if whole:
        issues += [f"field {w} missing in file" for w in wanted if w not in have]
        issues += [f"field {c} given twice" for c in sorted({c for c in have if have.count(c) > 1})]
    return "; ".join(issues) or None


def _ordered(columns: list[str], target: T.StructType) -> T.StructType:
    by_name = {f.name.lower(): f for f in target.fields}
    return T.StructType([by_name[c.lower()] for c in columns])


def _file_column() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_file")


def _out(df: DataFrame, target: T.StructType, corrupt=None, issues=None) -> DataFrame:
    return df.select(*[F.col(f.name) for f in target.fields],
                     (F.lit(None).cast("string") if corrupt is None else corrupt).alias(CORRUPT),
                     (F.array().cast("array<string>") if issues is None else issues).alias("_issues"), "_file")


def _csv(spark: SparkSession, files: list[str], schema: T.StructType, skip: int, target: T.StructType, multi_line: bool) -> DataFrame:
    """Files with one column order. The first ``skip`` lines are dropped by
    their place in the file, so a data row may equal one of them."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    if multi_line:
        df = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .option("header", skip == 1).option("multiLine", True).csv(files).select("*", _file_column()))
        return _out(df, target, F.col(CORRUPT))
    # a split's lines get consecutive numbers; a file's first split starts at byte 0
    text = spark.read.text(files).select("value", (F.col("_metadata.file_block_start") == 0).alias("_head"), _file_column(),
                                         F.monotonically_increasing_id().alias("_row"))
    if skip:
        first = text.filter("_head").groupBy("_file").agg(F.min("_row").alias("_first"))
        text = text.join(first, "_file", "left").filter(~F.col("_head") | (F.col("_row") >= F.col("_first") + skip))
    row = F.from_csv("value", full.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a field that goes on in the next line leaves an odd number of quotes in its first
    quotes = F.length(F.regexp_replace("value", r'\\.|[^"]', ""))
    issues = F.when(quotes % 2 == 1, F.array(F.lit(SPANS))).otherwise(F.array().cast("array<string>"))
    return _out(text.filter(F.length("value") > 0).select(row.alias("r"), issues.alias("_x"), "_file").select("r.*", "_x", "_file"), target,
                F.col(CORRUPT), F.col("_x"))


def _json(spark: SparkSession, files: list[str], target: T.StructType) -> DataFrame:
    """One JSON object per line; the keys of every row are kept with it."""
    full = T.StructType(list(target.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    text = spark.read.text(files).select("value", _file_column()).filter(F.trim("value") != "")
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    names = F.array(*[F.lit(f.name.lower()) for f in target.fields])
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    foreign = F.filter(keys, lambda k: ~F.array_contains(names, F.lower(k)))
    issues = F.transform(foreign, lambda k: F.concat(F.lit("field "), k, F.lit(" not found in destination")))
    return _out(text.select(row.alias("r"), issues.alias("_x"), "_file").select("r.*", "_x", "_file"), target,
                F.col(CORRUPT), F.col("_x"))


def _parquet(spark: SparkSession, files: list[str], target: T.StructType) -> DataFrame:
    return _out(spark.read.schema(target).parquet(*files).select("*", _file_column()), target)


def _footer_issues(spark: SparkSession, files: list[str], target: T.StructType) -> dict[str, str | None]:
    """Why each PARQUET file is refused. A group whose merged columns are the
    target's is accepted whole; another one is halved, down to single files."""
    def columns(some):
        try:
            return spark.read.option("mergeSchema", len(some) > 1).parquet(*some).columns
        except (PySparkException, Py4JJavaError):  # types that do not merge
            if len(some) == 1:
                raise
    out, groups = {}, [files] if files else []
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        while groups:
            halves = []
            for some, found in zip(groups, list(pool.map(columns, groups)), strict=True):
                issue = found and schema_issue(found, target, whole=False)
                if len(some) > 1 and (found is None or issue):
                    halves += [some[:len(some) // 2], some[len(some) // 2:]]
                else:
                    out |= dict.fromkeys(some, issue or None)
            groups = halves
    return out


def stage(spark: SparkSession, sources, target: T.StructType, skip_header: int = 1, multi_line: bool = False,
          done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse every file of ``sources`` [(path, format)] once, but for those
    whose fingerprint is in ``done``.

    Returns (parsed rows, files): the rows are a staging table in the shared
    folder; files is (_file, file_format, fingerprint, message), with the
    reason of a refusal that the columns alone give."""
    if multi_line and skip_header > 1:
        raise ValueError("multi_line skips at most the header line")
    target = T.StructType([T.StructField(f.name, f.dataType, True) for f in target.fields])
    for _, fmt in sources:
        if fmt.upper() not in FORMATS:
            raise ValueError(f"unsupported file format {fmt}")
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        folders = list(pool.map(lambda source: list_files(spark, source[0]), sources))
    listed = [(file, fmt.upper(), mark) for (_, fmt), some in zip(sources, folders, strict=True) for file, mark in some]
    if done is not None and listed:
        given = spark.createDataFrame(listed, "file string, fmt string, fingerprint string")
        listed = sorted(tuple(r) for r in given.join(done.select("fingerprint"), "fingerprint", "left_anti")
                        .select("file", "fmt", "fingerprint").collect())

    def head(item):
        file, fmt, _ = item
        return first_lines(spark, file, skip_header) if fmt == "CSV" and skip_header else None
    footers = _footer_issues(spark, [file for file, fmt, _ in listed if fmt == "PARQUET"], target)
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        heads = list(pool.map(head, listed))
    known = {line: _header(spark, line) for line in {h[-1] for x, h in zip(listed, heads, strict=True)
                                                     if x[1] == "CSV" and skip_header and len(h) == skip_header}}
    groups, files = {}, []
    for (file, fmt, mark), found in zip(listed, heads, strict=True):
        issue, columns = None, []
        if fmt == "CSV" and skip_header:
            columns = known[found[-1]] if len(found) == skip_header else []
            issue = schema_issue(columns, target, whole=True)
        elif fmt == "PARQUET":
            issue = footers[file]
        files.append((file, fmt, mark, issue))
        if issue is None:
            groups.setdefault((fmt, tuple(columns)), []).append(file)
    parsed = spark.createDataFrame([], T.StructType(list(target.fields))).select(
        "*", F.lit(None).cast("string").alias(CORRUPT), F.array().cast("array<string>").alias("_issues"),
        F.lit("").alias("_file"))
    for (fmt, columns), some in groups.items():
        if fmt == "CSV":
            df = _csv(spark, some, _ordered(list(columns), target) if columns else target, skip_header, target, multi_line)
        else:
            df = _json(spark, some, target) if fmt == "JSON" else _parquet(spark, some, target)
        parsed = parsed.unionByName(df)
    root = scratch_path(spark, "staged")
    parsed.write.parquet(root)
    return (spark.read.schema(parsed.schema).parquet(root),
            spark.createDataFrame(files, "_file string, file_format string, fingerprint string, message string"))


def load_log(parsed: DataFrame, files: DataFrame, root: str, now: str, stage_name: str = "@BANKING_STAGE") -> DataFrame:
    """One row per file: LOADED or FAILED with the reason, rows and errors.
    ``file_name`` is the path below ``root``, without Spark's job suffix."""
    good = F.col(CORRUPT).isNull()
    found = parsed.groupBy("_file").agg(
        F.count(F.when(good, 1)).alias("good"), F.count(F.when(~good, 1)).alias("bad"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_issues")))).alias("issues"))
    message = F.coalesce("message", F.when(F.size("issues") > 0, F.array_join("issues", "; ")))
    rel = F.regexp_replace(F.substring("_file", len(_normal(root)) + 2, 4096), r"-[0-9a-f]{8}-[0-9a-f-]{27}.*$", "")
    loaded = message.isNull()
    log = files.join(found, "_file", "left").select(
        "_file", "fingerprint", rel.alias("file_name"), "file_format", F.lit(stage_name).alias("stage"),
        F.when(loaded, "LOADED").otherwise("FAILED").alias("status"),
        F.when(loaded, F.coalesce("good", F.lit(0))).otherwise(0).cast("bigint").alias("rows_loaded"),
        F.when(loaded, F.coalesce("bad", F.lit(0))).otherwise(0).cast("bigint").alias("errors"), message.alias("message"))
    return log.withColumn("load_id", F.concat(F.lit("LD-"), F.upper(F.sha2(
        F.concat_ws("|", "file_name", "file_format", F.lit(now)), 256)))) \
        .withColumn("loaded_at", F.lit(now).cast("timestamp_ntz"))


def _normal(path: str) -> str:
    """A path the way ``_file`` shows it."""
    path = path.rstrip("/")
    if path.startswith("file:"):
        return "file:/" + path[5:].lstrip("/")
    return "file:" + path if path.startswith("/") else path


def load_files(spark: SparkSession, sources, target: T.StructType, root: str, stage_name: str = "@BANKING_STAGE",
               now: str | None = None, skip_header: int = 1, multi_line: bool = False,
               done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Load [(path, format)]: (good rows of the accepted files, log per file)."""
    now = now or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    parsed, files = stage(spark, sources, target, skip_header, multi_line, done)
    log = load_log(parsed, files, root, now, stage_name)
    accepted = log.filter("status = 'LOADED'").select("_file")
    rows = parsed.filter(F.col(CORRUPT).isNull()).join(accepted, "_file", "left_semi")
    return rows.select(*[f.name for f in target.fields]), log.drop("_file")


def _loads(spark: SparkSession, history_path: str) -> list[str]:
    """Folder names of the committed loads."""
    fs, p = hadoop_path(spark, history_path)
    if not fs.exists(p):
        return []
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(p)
                  if s.getPath().getName().startswith("load=") and fs.exists(make(s.getPath(), "_SUCCESS")))


def read_history(spark: SparkSession, history_path: str) -> DataFrame:
    """The log of all committed loads, one row per file and load."""
    paths = [f"{history_path}/{x}" for x in _loads(spark, history_path)]
    return spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)


def read_loaded(spark: SparkSession, target: T.StructType, table_path: str, history_path: str) -> DataFrame:
    """The table: files that were in its folder before, and the rows of all committed loads."""
    fs, p = hadoop_path(spark, f"{table_path}/*.parquet")
    paths = [f"{table_path}/*.parquet"] if fs.globStatus(p) else []
    paths += [f"{table_path}/{x}" for x in _loads(spark, history_path)]
    return spark.read.schema(target).parquet(*paths) if paths else spark.createDataFrame([], target)


def copy_into(spark: SparkSession, sources, target: T.StructType, root: str, table_path: str, history_path: str,
              now: str | None = None, skip_header: int = 1, multi_line: bool = False, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Load the files that are not loaded yet; returns the table and the
    history as they are afterwards."""
    done = None if force else read_history(spark, history_path).filter("status = 'LOADED'").select("fingerprint").distinct()
    rows, log = load_files(spark, sources, target, root, now=now, skip_header=skip_header, multi_line=multi_line, done=done)
    if not log.isEmpty():
        load = f"load={uuid.uuid4().hex}"
        rows.write.parquet(f"{table_path}/{load}")
        log.select(*LOG.names).write.parquet(f"{history_path}/{load}")
    return read_loaded(spark, target, table_path, history_path), read_history(spark, history_path)
