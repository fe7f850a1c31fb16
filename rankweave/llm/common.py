"""What the operators of this subpackage share: shared scratch tables and column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session, or one of our own where that is unset and Spark runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: tasks on several machines need a folder that all of them share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def parts(rows: int, each: int = 200_000) -> int:
    """Files for a table of so many rows, so that small ones in loops are not written as one tiny file a shuffle partition."""
    return max(4, -(-rows // each))


def stage(df: DataFrame, name: str = "stage", files: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, in ``files`` files at most, and read it back, so that a lost executor costs a reread only."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the tables that ``stage`` wrote for these, once all that is made of them is written itself; others are left alone."""
    for df in frames:
        path = getattr(df, "stage_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_arrow(df: DataFrame, fields: str, make) -> DataFrame:
    """``df`` with the columns of the DDL string ``fields``, which replace columns of the same names.

    ``make(batch)`` gets Arrow record batches of at most ROWS rows and returns an array for each field.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    keep = [f for f in df.schema if f.name.lower() not in names]
    schema = StructType([*keep, *new])
    at = [i for i, f in enumerate(df.schema) if f.name.lower() not in names]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in slices(batches):
            made = make(batch)
            columns = [*(batch.column(i) for i in at), *made]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, out, strict=True)], names=out.names)

    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(make=None, *key):
    """``make(*key)``, made once in a task's process, or nothing.

    Processes outlive stages and the caches of such helpers are large, so that those of another kind go first.
    """
    for other in [x for x in _HELD if x is not make]:
        del _HELD[other]
    if make is None:
        return None
    own = _HELD.setdefault(make, {})
    if key not in own:
        if len(own) == 4:
            own.clear()
        own[key] = make(*key)
    return own[key]


#: Most rows of an Arrow batch that a task works on at once.
ROWS = 1000


def slices(batches):
    """Arrow batches in parts of at most ROWS rows, so that a task holds few texts twice."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            yield whole.slice(start, ROWS)


def text_bytes(batch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Code points that are worked on at once; a longer text is a chunk of its own.
CHUNK_CHARS = 250_000
HASH_BASE = 0x9E3779B97F4A7C15
_RUNS = None


def letters(text: str) -> str:
    """Lower-case letters of a text, with one space between runs and at both ends."""
    global _RUNS
    if _RUNS is None:
        import re

        _RUNS = re.compile(r"[\W\d_]+")
    return f" {_RUNS.sub(' ', text.lower()).strip()} "


def chunked(texts: list[str]):
    """(first, last) ranges of texts of CHUNK_CHARS together, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]):
    """(code points of all texts, the place where each begins)."""
    import numpy as np

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.cumsum([0, *map(len, texts)])


def mix(h):
    """Finalizer of 64-bit hashes, in numpy."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
