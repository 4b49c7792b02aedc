"""Session-level helpers: column selection, shared scratch space, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by exact name under internal aliases: ``pick(df, id="doc_id")``.

    Columns are addressed by position, so other columns may clash with them in
    everything but case, or carry dots, without making the reference ambiguous.
    """
    seen = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(seen))])
    return flat.select(*[F.col(f"_{seen.index(name)}").alias(alias) for alias, name in names.items()])


def _ordered_type(kind: T.DataType) -> bool:
    """Whether Spark can compare and hash values of a type."""
    if isinstance(kind, T.ArrayType):
        return _ordered_type(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered_type(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def comparable(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns that can be compared and hashed: those of ``df``, and JSON texts for maps, variants and what holds them."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [F.col(n) if _ordered_type(kinds[n]) else F.to_json(F.struct(n)).alias(n) for n in names]


def only_rows(docs: DataFrame, id_col: str, stays: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """One row of ``docs`` for each row of ``stays`` (_id and the marks), the least of those that agree with it.

    ``marks`` are expressions over the columns c0, c1, ... of ``docs`` by position. Maps and variants, which have no
    order, are compared as JSON.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumns(marks)
    theirs = stays.toDF(*[f"s{c}" for c in stays.columns])
    same = F.col(f"c{docs.columns.index(id_col)}").eqNullSafe(F.col("s_id"))
    for m in marks:
        same = same & (F.col(m) == F.col(f"s{m}"))
    keys, row = comparable(rows, names), F.struct(*names)
    plain = all(_ordered_type(f.dataType) for f in docs.schema)
    least = F.min(row) if plain else F.min_by(row, F.struct(*keys))
    kept = rows.join(theirs, same).groupBy("s_id", *marks).agg(least.alias("row"))
    return kept.select("row.*").toDF(*docs.columns)


SMALL_BYTES = 32 << 20


def _orders(text: str) -> list[Column]:
    """Sort columns of an ORDER BY list."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    found = []
    for part in (p.strip() for p in parts):
        down = part.upper().endswith(" DESC")
        column = F.expr(part[:-5] if down else part)
        found.append(column.desc() if down else column.asc())
    return found


def reads_files(df: DataFrame) -> bool:
    """Whether ``df`` is no more than columns and filters, the same each time, over files: storing it would copy them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def with_place(df: DataFrame, order: str, alias: str, again: bool = False) -> DataFrame:
    """``df`` with the place 1, 2, ... of each row in a total order.

    Rows go to tasks by ranges of the order and are stored sorted with a running number, which holds the range and the
    place inside; the counts of the ranges before are added. The rows are stored first, so that their real size is known
    and all passes see the same ranges; what is small is ordered in one task instead. With ``again`` rows that come from files
    as they are, as those of an earlier place do, are read from there each time and not stored.
    """
    df = df if again and reads_files(df) else stored(df, "unplaced")
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return df.selectExpr("*", f"row_number() over (order by {order}) as `{alias}`")
    by = _orders(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_number", F.monotonically_increasing_id())
    ranges = stored(ranges, "ranges")
    number = {"_range": F.shiftright("_number", 33), "_inside": F.col("_number").bitwiseAND((1 << 33) - 1) + 1}
    counts = ranges.select(*[c.alias(k) for k, c in number.items()]).groupBy("_range").agg(F.max("_inside").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    if again:  # the rows stay a scan of the ranges
        befores = {r["_range"]: r["_before"] for r in offsets.collect()}
        ahead = F.lit([befores.get(i, 0) for i in range(n)])
        return ranges.withColumns(number).withColumn(alias, F.get(ahead, F.col("_range").cast("int")).cast("long") + F.col("_inside")).drop("_range", "_inside", "_number")
    placed = ranges.withColumns(number).join(F.broadcast(offsets), "_range")
    return placed.withColumn(alias, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside", "_number")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share. Only a session whose executors are threads of the driver may go without
    a configured one and gets a temporary folder; on a cluster it would lie on one machine's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="crossmotif-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return re.sub(r"^file:/+", "file:///", folder).rstrip("/")  # Spark itself writes file:/ with one slash


_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder, which goes when the session's JVM ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[key])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_folders[key]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the result survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small iterative state."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
