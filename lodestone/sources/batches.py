"""A vector index built in numbered batches, each committed once by a manifest.

Rows are dealt to batches by a hash of their id and staged, so a build that goes on later meets the same batches. A
batch is encoded into a folder of its own attempt and counts once its manifest stands, which is renamed into
place only where none is. So a batch that was lost on the way is missing and run again, one that runs twice is
committed once, and what other attempts left is never read. The manifests are small, one a batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import normalized
from lodestone.operators.rows import number

MANIFEST = "batch int, folder string, n long, dim int, checksum long"


class IndexBuild:
    """The index at `path`, of `n_batches` batches. Every batch has `id_col` and `vector`; `encode` makes a staged
    batch into rows with these columns, by default by unit length."""

    def __init__(self, spark: SparkSession, path: str, n_batches: int, id_col: str = "vec_id", vector: str = "embedding", encode: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.n_batches, self.id_col, self.vector = spark, path.rstrip("/"), n_batches, id_col, vector
        self.encode = encode or (lambda df: df.withColumn(vector, F.transform(normalized(F.col(vector)), lambda x: x.cast("float"))))
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        at = self._hadoop.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def stage(self, rows: DataFrame) -> None:
        """Deal the rows to batches, if that has not been done."""
        if not self._exists(f"{self.path}/staged/_SUCCESS"):
            dealt = rows.withColumn("_batch", F.pmod(F.xxhash64(self.id_col), F.lit(self.n_batches)).cast("int"))
            place = ("_batch", F.xxhash64(self.id_col, F.lit(1)))
            # By ranges, so that a file holds few batches and the footers tell which.
            dealt.repartitionByRange(*place).sortWithinPartitions("_batch").write.mode("overwrite").parquet(f"{self.path}/staged")

    def manifests(self) -> DataFrame:
        if not self._exists(f"{self.path}/manifests"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests")

    def pending(self) -> list[int]:
        done = {r.batch for r in self.manifests().select("batch").collect()}
        return [k for k in range(self.n_batches) if k not in done]

    def attempt(self, batch: int) -> dict:
        """Encode one batch into a folder of its own, and say what is in it."""
        folder = f"{self.path}/vectors/{batch:05d}-{uuid.uuid4().hex}"
        staged = self.spark.read.parquet(f"{self.path}/staged")
        self.encode(staged.where(F.col("_batch") == batch).drop("_batch")).write.parquet(folder)
        found = self._checked(self.spark.read.parquet(folder)).first()
        return {"batch": batch, "folder": folder, "n": found["n"], "dim": found["dim"], "checksum": found["checksum"]}

    def _checked(self, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(self.vector)).alias("dim"), F.coalesce(F.bit_xor(F.xxhash64(self.id_col, self.vector)), F.lit(0)).alias("checksum"))

    def commit(self, manifest: dict) -> bool:
        """Put the manifest in place; False where the batch is committed already."""
        target = f"{self.path}/manifests/{manifest['batch']:05d}.json"
        fs, draft = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else self._hadoop.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._hadoop.Path(target), gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as refused:
            if "FileAlreadyExistsException" not in str(refused):
                raise
            fs.delete(draft, False)
            return False
        return True

    def run(self, batches: list[int] | None = None) -> None:
        """Build the batches that are pending, or those of them that are named."""
        for batch in self.pending():
            if batches is None or batch in batches:
                self.commit(self.attempt(batch))

    def read(self, partial: bool = False) -> DataFrame:
        """The committed rows; an incomplete index is an error unless `partial`."""
        done = self.manifests().orderBy("batch").collect()
        if len(done) < self.n_batches and not partial:
            raise ValueError(f"{self.n_batches - len(done)} of {self.n_batches} batches are missing")
        if not done:
            raise ValueError("no batch is committed")
        return self.spark.read.parquet(*[r.folder for r in done])

    def damaged(self) -> list[int]:
        """Committed batches whose files no longer hold what their manifest says."""
        out = []
        for r in self.manifests().orderBy("batch").collect():
            found = self._checked(self.spark.read.parquet(r.folder)).first() if self._exists(r.folder) else None
            if found is None or (found["n"], found["checksum"]) != (r.n, r.checksum):
                out.append(r.batch)
        return out

    def metadata(self) -> DataFrame:
        """One row, of the manifests alone: n_vectors, dim, n_batches, complete."""
        m = self.manifests().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.max("dim").alias("dim"), F.count(F.lit(1)).alias("n_batches"))
        return m.withColumn("complete", F.col("n_batches") == self.n_batches)

    def publish(self, out: str, order: str | None = None) -> DataFrame:
        """The whole index in one order with the position of each row, written to `out`."""
        number(self.read(), order or self.id_col, name="pos").write.mode("overwrite").parquet(out)
        return self.spark.read.parquet(out)
