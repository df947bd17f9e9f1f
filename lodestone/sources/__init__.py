"""Readers and writers of passages, question sets, probabilities and vectors.

Every reader takes a schema where the format has none, so no pass over the data infers one, and keeps
to paths that Spark's file systems resolve.
"""

from __future__ import annotations

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import anchors_to_text, strip
from lodestone.functions.vectors import normalized
from lodestone.operators.rows import number
from lodestone.tables import scratch

ARTICLES = "id string, title string, url string, text array<array<string>>"
PASSAGES = "text string"
TRIPLETS = "text string, triplet string"
SELFRAG = "instruction string, output string, input string, id string, dataset_name string"


def read_jsonl(spark: SparkSession, path: str, schema: str = PASSAGES, drop_malformed: bool = False) -> DataFrame:
    """JSON lines; a bad line is null in all fields, or left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").json(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs of a text and its triples, from JSON lines; a triplet that is not text is its JSON. Lines without a
    text or a triplet are left out."""
    rows = read_jsonl(spark, path, TRIPLETS)
    return rows.select("text", strip(F.col("triplet")).alias("triplet")).where("text IS NOT NULL AND triplet <> ''")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array or object a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: .json is one document a file, anything else JSON lines."""
    return read_json(spark, path, schema) if path.endswith(".json") else read_jsonl(spark, path, schema)


def read_articles(spark: SparkSession, path: str, batch: str = "file") -> DataFrame:
    """Compressed article dumps in folders: paragraphs are joined sentences with anchors replaced by their
    text; unreadable lines are left out. `file` numbers the batches in path order, which are files or, by `batch`, the
    folders they lie in; the numbers come from the list of files, not from what is in them."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.bz2"}
    rows = spark.read.schema(ARTICLES).option("mode", "DROPMALFORMED").options(**options).json(path)
    plain = lambda uri: F.regexp_replace(F.try_url_decode(uri), "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the list and the rows write them differently
    of = (lambda uri: F.regexp_replace(plain(uri), "/[^/]*$", "")) if batch == "folder" else plain
    listed = sorted({uri.rpartition("/")[0] + "/" if batch == "folder" else uri for uri in rows.inputFiles()})
    numbers = spark.createDataFrame(list(enumerate(listed)), "file int, uri string").select("file", of("uri").alias("_file"))
    told = rows.select("id", "title", "url", F.transform("text", lambda p: strip(anchors_to_text(F.array_join(p, "")))).alias("paragraphs"), of(F.col("_metadata.file_path")).alias("_file"))
    place = F.coalesce("file", F.raise_error(F.concat(F.lit("not a listed file: "), "_file")))
    return told.join(F.broadcast(numbers), "_file", "left").select("id", "title", "url", "paragraphs", place.cast("int").alias("file"))


def read_probabilities(spark: SparkSession, path: str, n_labels: int, text: str = "text", na: str = "NA") -> DataFrame:
    """text, theme from a wide CSV of label_0 .. label_(n-1); a missing text becomes [INVALID_TEXT], a
    missing probability 0."""
    schema = T.StructType([T.StructField(text, T.StringType()), *[T.StructField(f"label_{i}", T.FloatType()) for i in range(n_labels)]])
    rows = spark.read.schema(schema).option("header", True).option("nullValue", na).option("multiLine", True).option("escape", '"').csv(path)
    theme = F.array(*[F.coalesce(F.col(f"label_{i}"), F.lit(0.0).cast("float")) for i in range(n_labels)])
    return rows.select(F.coalesce(F.nullif(text, F.lit("")), F.lit("[INVALID_TEXT]")).alias("text"), theme.alias("theme"))


def read_columnar(spark: SparkSession, path: str, schema: str, first: int | None = None, by: str | None = None) -> DataFrame:
    """A test set stored as parallel lists, one row per position `ord`; optionally the first rows of each file. `by` is the
    column that the folders of the files name."""
    wide = read_json(spark, path, schema)
    lists, kept = [c for c in wide.columns if c != by], [by] if by else []
    rows = wide.select(*kept, F.posexplode(F.arrays_zip(*lists)).alias("ord", "x")).select(*kept, "ord", "x.*")
    return rows if first is None else rows.where(F.col("ord") < first)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The partitions of a split dataset that are there."""
    return spark.read.parquet(folder).where(F.col("split").isin(*splits))


def read_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """The text column of a CSV file with a header, for inference."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(F.col(column).alias("text"))


def read_index(spark: SparkSession, path: str, split: str, splits: list | None = None) -> DataFrame:
    """Vectors, ids and texts of an index; only the folders of the wanted splits are read."""
    rows = spark.read.parquet(f"{path}/vectors")
    return rows if splits is None else rows.where(F.col(split).isin(*splits))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, *order: str) -> int:
    """One file with a JSON array of the rows in a total order, and their number. Tasks write ranges of the array as text
    of their own, brackets and commas included, so that the files' concatenation is the array; the store joins
    them where it can (`concat`), and else they are copied one after another through a stream."""
    spark = df.sparkSession
    parts = scratch(spark, "json")
    n = df.count()
    placed = number(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json"), *order), *order, name="_pos").select("_json", "_pos")
    line = F.concat(F.when(F.col("_pos") == 0, "[").otherwise(""), "_json", F.when(F.col("_pos") == n - 1, "]").otherwise(","))
    if n:
        placed.repartitionByRange("_pos").sortWithinPartitions("_pos").select(line.alias("value")).write.text(parts)
    else:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(parts)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(hadoop.fs.Path(parts)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    fs.delete(target, False)
    gateway = spark.sparkContext._gateway
    rest = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(files) - 1)
    for k, file in enumerate(files[1:]):
        rest[k] = file
    try:
        fs.concat(files[0], rest)
        fs.rename(files[0], target)
    except UnsupportedOperationException:
        out = fs.create(target, True)
        for file in files:
            into = fs.open(file)
            hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
            into.close()
        out.close()
    return n


def write_csv(df: DataFrame, path: str, column: str = "text") -> None:
    """Every field quoted; rows without text left out."""
    df.where(F.col(column) != "").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, name: str = "split", sample: int = 0) -> None:
    """A folder a split, and beside them `sample` rows as JSON lines to look at."""
    df.write.mode("overwrite").partitionBy(name).parquet(path)
    if sample:
        df.sparkSession.read.parquet(path).limit(sample).write.mode("overwrite").json(f"{path.rstrip('/')}_sample")


def write_index(df: DataFrame, path: str, vector: str = "embedding", split: str | None = None) -> DataFrame:
    """Unit vectors with their ids and texts, and beside them one row of metadata, which is returned."""
    spark = df.sparkSession
    unit = df.withColumn(vector, F.transform(normalized(F.col(vector)), lambda x: x.cast("float")))
    writer = unit.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(f"{path}/vectors")
    meta = spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size(vector)).alias("dim"), F.lit("ip").alias("metric"))
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return spark.read.schema(meta.schema).json(f"{path}/metadata")
