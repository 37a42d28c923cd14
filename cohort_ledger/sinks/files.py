"""Many small files, each of one row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.session import cut
from cohort_ledger.sources.digests import located

FOLDERS = 64  #: folders that the files are dealt to


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, spelled as ``binaryFile`` lists it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()


def write_files(rows: DataFrame, root: str, name: str = "name", content: str = "content", folders: int = FOLDERS) -> DataFrame:
    """A file for each row, named ``name`` and holding ``content``; the rows with the ``path`` of their files.

    ``partitionBy`` makes a folder, a temporary file and a rename by the driver
    of every file.  Here the tasks write the files where they stay, in
    ``folders`` folders by the hash of the name, a folder's by one task; a task
    that is repeated writes the same bytes again.  The file system is any that
    pyarrow opens from a URI.  Rows of one name share a file, so their contents
    must be equal; a row without a name or content has no file and no row.
    """
    spark = rows.sparkSession
    base = qualified(spark, root)
    path = F.concat(F.lit(f"{base}/"), F.col("_folder").cast("string"), F.lit("/"), F.col(name))
    placed = rows.filter(F.col(name).isNotNull() & F.col(content).isNotNull()).withColumn("_folder", F.pmod(F.xxhash64(name), F.lit(folders)))
    # As many tasks as there are folders: files are the work, not the bytes of the rows.
    placed = placed.repartition(folders, "_folder").withColumn("path", path).drop("_folder")
    names = placed.columns

    def run(batches) -> Iterator:
        made = set()
        for batch in batches:
            at, held = (batch.column(names.index(c)).to_pylist() for c in ("path", content))
            for file, body in zip(at, held, strict=True):
                system, inner = located(file)
                folder = inner.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(inner, compression=None) as out:
                    out.write(body.encode() if isinstance(body, str) else body)
            yield batch

    return cut(placed.mapInArrow(run, placed.schema))
