"""Parquet and CSV scans, folder trees with metadata in the path, partitioned and plain sinks."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lookup, zero_pad
from ..operators.schema import ELECTION_SCHEMA, conform
from . import records

_COMPARE = {
    "==": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
}


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[tuple] = ()) -> DataFrame:
    """Columns and (column, operator, value) filters; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    for name, op, value in filters:
        df = df.where(_COMPARE[op](F.col(name), value))
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, drop_null_rows: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """CSV with header; without a schema every column is text, which keeps codes such as 01001 whole."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.na.drop("any") if drop_null_rows else df


def scan_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the rejected records as (_corrupt, reason, path).

    Cells go to the schema's fields by position. Besides what ``records`` rejects, a record is
    rejected if a cell does not have its field's type. ``header`` skips the first record of each file.
    """
    parsed, _ = records.scan_records(spark, path, records.Dialect(sep, encoding=encoding, header=header), columns=schema.names)
    typed = parsed.withColumns({f"_v{i}": F.get("cells", F.lit(i)).try_cast(f.dataType) for i, f in enumerate(schema.fields)})
    wrong = F.lit(False)
    for i in range(len(schema.fields)):
        wrong |= F.get("cells", F.lit(i)).isNotNull() & F.col(f"_v{i}").isNull()
    good = typed.where(F.col("reason").isNull() & ~wrong).select(*(F.col(f"_v{i}").alias(f.name) for i, f in enumerate(schema.fields)))
    text = F.coalesce("text", F.array_join("cells", sep, ""))
    bad = typed.where(F.col("reason").isNotNull() | wrong).select(text.alias("_corrupt"), F.coalesce("reason", F.lit("type")).alias("reason"), "path")
    return good, bad


_TREE_PATH = r"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?(\d{4})/(.+)$"


def csv_tree_to_parquet(
    spark: SparkSession, source: str, target: str, sep: str = ",", partitions: list[str] = ("election_type", "year"), encoding: str = "UTF-8", file_column: str = "source_file"
) -> DataFrame:
    """CSV files under ``{type}/{year}`` folders to Parquet partitioned by type and year, every column as text.

    Files differ in their columns: each file's header names its cells, and columns are matched
    by name, null where a file lacks them. ``file_column`` holds the path below the year.
    Rejected records are returned as (_corrupt, reason, path).
    """
    parsed, names = records.scan_records(spark, source, records.Dialect(sep, encoding=encoding), pattern="*.csv")
    if not names:
        raise FileNotFoundError(f"no CSV files below {source}")
    path = F.col("path")
    place = {partitions[0]: F.regexp_extract(path, _TREE_PATH, 1), partitions[1]: F.regexp_extract(path, _TREE_PATH, 2), file_column: F.regexp_extract(path, _TREE_PATH, 3)}
    rows = parsed.where("reason IS NULL").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), *(c.alias(n) for n, c in place.items()))
    rows.write.mode("errorifexists").partitionBy(*partitions).parquet(target)
    return parsed.where("reason IS NOT NULL").select(F.col("text").alias("_corrupt"), "reason", "path")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; hidden files are skipped and no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length").where(~name.startswith(".") & ~name.startswith("_"))


# Fixed layout: {kind}/{year}/{code}_csv/file, each folder named plainly or as key=value.
_EVENT_PATH = r"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?(\d{4})/(?:[^/=]+=)?([^/=]+)_csv/[^/]+\.parquet$"

# Spelling variants of event kinds in folder names.
KIND_SPELLING = {"referundum": "referendum"}


def scan_event_tree(spark: SparkSession, root: str, kinds: dict[str, int]) -> DataFrame:
    """Event results below ``{kind}/{year}/{code}_csv/``: kind, period and event come from the path.

    Only the configured kinds are read. Files of one folder share a schema but folders do
    not: the folders of each distinct schema are one scan conformed to the fixed schema, and
    the scans are united, so the plan grows with the layouts and not with the folders.
    """
    files = list_files(spark, root, "*.parquet").select("path", F.regexp_extract("path", _EVENT_PATH, 1).alias("k"))
    spelled = lookup("k", KIND_SPELLING, F.col("k"))
    folders = files.where(spelled.isin(list(kinds))).select(F.regexp_replace("path", r"/[^/]+$", "").alias("f")).distinct()
    layouts: dict[str, list[str]] = {}
    for (folder,) in folders.orderBy("f").collect():
        layouts.setdefault(spark.read.parquet(folder).schema.json(), []).append(folder)
    out = None
    for paths in layouts.values():
        part = spark.read.parquet(*paths)
        path = F.col("_metadata.file_path")
        kind = F.regexp_extract(path, _EVENT_PATH, 1)
        kind = lookup(kind, KIND_SPELLING, kind)
        meta = {
            "kind": kind,
            "period": F.regexp_extract(path, _EVENT_PATH, 2).cast("bigint"),
            "event": F.regexp_extract(path, _EVENT_PATH, 3),
            "kind_no": lookup(kind, kinds).cast("tinyint"),
        }
        part = part.withColumns(meta)
        if "entity" in part.columns:
            part = part.withColumn("entity", zero_pad("entity"))
        part = conform(part, ELECTION_SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no event files of kinds {sorted(kinds)} below {root}")
    return out


def route_by_level(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Table paths by level: names holding 'communes' are entity tables, 'departements' region tables; 'codes…' are skipped.

    A table is one file, or a folder named like one.
    """
    table = F.regexp_replace("path", r"(\.parquet)/[^/]+$", "$1")
    tables = list_files(spark, root, "*.parquet").select(table.alias("path")).distinct().withColumn("n", F.element_at(F.split("path", "/"), -1))
    level = F.when(F.col("n").startswith("codes"), None).when(F.col("n").contains("communes"), "entity").when(F.col("n").contains("departements"), "region")
    rows = tables.select("path", level.alias("level")).where("level IS NOT NULL").orderBy("path").collect()
    return {lv: [r["path"] for r in rows if r["level"] == lv] for lv in ("entity", "region")}


# Link prefixes and the folder of each.
LINK_FOLDERS = {"pre": "presidentiel", "ref": "referendum", "leg": "legislative"}
# The place of the year in the name, one further on for this prefix.
_LONG_PREFIX = "pre"
# Events filed under the following year, and the month that their names then lose.
LATE_EVENTS = ["leg1871juil", "leg1946Nov"]
_MONTH = "juil|Nov$"


def link_layout(df: DataFrame, text: str) -> DataFrame:
    """Glued links to (url, kind, year, target): archives only, folder by prefix, late events one year on.

    The name is the last part of the link up to its first ``_``. Links of unknown kind have no
    kind and year and stay in the base folder.
    """
    urls = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(https?://(?:(?!https?://).)*?(?:csv|csp)\.zip)"), F.lit(1))).alias("url"))
    name = F.element_at(F.split(F.element_at(F.split("url", "/"), -1), "_"), 1)
    prefix = F.substring(name, 1, 3)
    kind = lookup(prefix, LINK_FOLDERS)
    written = F.when(prefix == _LONG_PREFIX, F.substring(name, 5, 4)).otherwise(F.substring(name, 4, 4))
    late = name.isin(LATE_EVENTS)
    year = F.when(late, (written.try_cast("int") + 1).cast("string")).otherwise(written)
    named = urls.select("url", kind.alias("kind"), F.when(kind.isNotNull(), year).alias("_y"), F.when(late, F.regexp_replace(name, _MONTH, "")).otherwise(name).alias("code"))
    return named.select("url", "kind", F.col("_y").try_cast("int").alias("year"), "code", F.concat_ws("/", "kind", "_y", "code").alias("target"))


# ---- partitions and sinks ----


def write_partitioned(df: DataFrame, path: str, key: str, files_per_key: int = 8) -> None:
    """One folder per key value. A key may hold a large part of the rows: ``files_per_key`` tasks share it."""
    share = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(files_per_key))
    df.withColumn("_share", share).repartition(key, "_share").drop("_share").write.mode("errorifexists").partitionBy(key).parquet(path)


def read_partition(spark: SparkSession, path: str, key: str, value, bounds: DataFrame | None = None) -> DataFrame:
    """Rows of one partition folder (pruned at planning) with the bounds of its bin."""
    part = spark.read.parquet(path).where(F.col(key) == value)
    return part if bounds is None else part.join(bounds, key)


def run_path(root: str, name: str, stamp: str | None = None) -> str:
    """Target path with a run id, so that no run overwrites another."""
    return f"{root}/{name}_{stamp or time.strftime('%Y%m%d_%H%M%S')}"


def write_parquet(df: DataFrame, root: str, name: str, stamp: str | None = None) -> str:
    path = run_path(root, name, stamp)
    df.write.mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def build_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the table at ``path``; build and write it first when its success marker is absent."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_models(spark: SparkSession, models: dict[str, tuple[PipelineModel, list[str]]], path: str, data_path: str, sample: DataFrame) -> None:
    """One model folder per trend and a manifest row with features, data path and a five-row signature."""
    for trend, (model, _) in models.items():
        model.write().overwrite().save(f"{path}/{trend}")
    signature = [str(r.asDict()) for r in sample.limit(5).collect()]
    rows = [(t, f, data_path, signature, type(m.stages[-1]).__name__) for t, (m, f) in models.items()]
    schema = "trend string, features array<string>, data_path string, signature array<string>, model_class string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_models(spark: SparkSession, path: str) -> dict[str, tuple[PipelineModel, list[str]]]:
    """Models and features of a manifest; a folder that holds another model class is an error."""
    out = {}
    for row in spark.read.parquet(f"{path}/manifest").collect():
        model = PipelineModel.load(f"{path}/{row['trend']}")
        if type(model.stages[-1]).__name__ != row["model_class"]:
            raise TypeError(f"{row['trend']} holds {type(model.stages[-1]).__name__}, not {row['model_class']}")
        out[row["trend"]] = (model, list(row["features"]))
    return out



def feature_catalogue(spark: SparkSession, features: dict[str, dict]) -> DataFrame:
    """Feature metadata (years, description, type, unit, level) as a small dimension table."""
    rows = [(n, m.get("years", []), m.get("description"), m.get("type"), m.get("unit"), m.get("level")) for n, m in features.items()]
    return spark.createDataFrame(rows, "feature string, years array<int>, description string, type string, unit string, level string")
