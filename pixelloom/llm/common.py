"""What several operators share: written tables, checked broadcasts, word
counts and distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of files up to which a written table is broadcast in a join; in memory it may have twice as many.
BROADCAST_BYTES = 32 << 20
_WIDTHS = {"bigint": 8, "int": 8, "double": 8, "boolean": 8}
#: Rows that one task ranks or sums at a time, about.
ROWS_PER_BUCKET = 200_000

_LOCAL: dict[str, str] = {}
#: The tables that exist, oldest first.
_OPEN: list[Table] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a
    local master, as in tests, gets a folder of its own where it is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
    return _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have been stopped before
        pass


class Table:
    """A DataFrame written as Parquet in the shared folder: it cuts the
    lineage, survives lost executors, and its size is known."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _OPEN.append(self)
        atexit.register(_delete_at_exit, self.spark, self.path)

    def bytes(self) -> int:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength()

    def small(self, df: DataFrame | None = None) -> DataFrame:
        """The rows (or those of ``df``, which has some of the columns), marked for
        broadcasting if they are few enough; Spark chooses a shuffled join otherwise."""
        df = self.df if df is None else df
        if self.bytes() > BROADCAST_BYTES:
            return df
        # compressed files don't tell the size in memory: rows (from the files' footers) by their width
        width = 16 + sum(_WIDTHS.get(kind, 64) for _, kind in df.dtypes)
        return F.broadcast(df) if self.df.count() * width <= BROADCAST_BYTES * 2 else df

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        if self in _OPEN:
            _OPEN.remove(self)
        _delete(self.spark, self.path)


@contextmanager
def scratch():
    """Gives done(df, name): the written result as a DataFrame, after which the
    tables that were made on the way to it, within this block, are deleted."""
    kept = list(_OPEN)

    def done(df: DataFrame, name: str) -> DataFrame:
        made = [t for t in _OPEN if t not in kept and t.spark is df.sparkSession]
        out = Table(df, name)
        for t in made:
            t.drop()
        return out.df

    yield done


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where they come in fewer partitions than there are
    cores (a small table in one file); else the DataFrame as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def free_name(df: DataFrame, name: str, *others: str) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in [*df.columns, *others]}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_column(df: DataFrame, name: str) -> Column:
    """An id for use as a key: integers as long, other types as they are (those that
    can't be ordered or compared as JSON)."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "void"):
        return col(name).cast("long")
    return F.to_json(F.struct(col(name))) if "map<" in kind or "variant" in kind else col(name)


def plain_columns(df: DataFrame) -> list[Column]:
    """All columns, those that can't be compared or hashed as their JSON."""
    return [F.to_json(F.struct(col(c))) if "map<" in kind or "variant" in kind else col(c) for c, kind in df.dtypes]


def col(name: str) -> Column:
    """The column of just that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks, tabs, line ends and form feeds; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


#: The same in DuckDB's SQL.
WORD_COUNT_SQL = r"coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0)::BIGINT"


def buckets(n: Column) -> Column:
    """How many buckets n rows are cut into, for ranks and prefix sums."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(ROWS_PER_BUCKET)))).cast("long")


def bucket_of(key: Column, n_buckets: Column) -> Column:
    """The bucket of a hexadecimal key, in key order: its first 8 digits
    scaled to 0 .. n_buckets - 1. Hash keys fill the buckets evenly."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n_buckets / F.lit(4294967296)).cast("long")


def prefix_sums(df: DataFrame, groups: list[str], key: str, ties: list[str], amount: str, out: str) -> DataFrame:
    """Exclusive running sums of ``amount`` within ``groups`` in the order of the
    hash key, as column ``out``, without a task that holds a whole group.

    Each group's key range is cut into buckets of about ROWS_PER_BUCKET rows;
    rows are partitioned by (group, key range), sorted and summed there, and
    the sums of the group's earlier ranges are added. ``ties`` orders equal
    keys. Null groups form a group. ``df`` is read three times: give a written
    table of few columns."""
    names = [f"_g{i}" for i in range(len(groups))]
    keyed = [F.col(g).alias(n) for g, n in zip(groups, names)]
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)]
    sizes = Table(df.groupBy(*keyed).agg(buckets(F.count(F.lit(1))).alias("_nb")), "sizes").small()
    cut = df.join(sizes, same).withColumn("_bucket", bucket_of(F.col(key), F.col("_nb"))).drop("_nb", *names)
    earlier = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keyed, F.col("_bucket").alias("_b")).agg(F.sum(amount).alias("_sum")).select(*names, "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_before"))
    offsets = Table(offsets, "offsets").small()
    within = Window.partitionBy(*groups, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
    return summed.join(offsets, [*same, F.col("_bucket") == F.col("_b")]).withColumn(out, F.col("_before") + F.col("_within")).drop("_b", "_bucket", "_before", "_within", *names)
