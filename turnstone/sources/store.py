"""Collections as Parquet: create, upsert by id, read, delete, compact, export.

A collection is a folder of segments and numbered manifests. Each upsert writes one segment, of the new rows alone, and
then a manifest that lists all segments in order; the highest manifest counts, and it appears by one rename, so a crash at
any point leaves the collection as it was, and readers see all of an upsert or nothing. A row of a later segment replaces
that of the same id in earlier ones. After SEGMENTS upserts they are merged into one. One writer a collection: a second one
that makes the same manifest fails and may try again."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.ops import latest

SEGMENTS = 8


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def literal(path: str) -> str:
    """For readers that take patterns: this very path."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _folder(table: str, persona: str) -> str:
    return f"{table}/{persona}"


def _latest(spark: SparkSession, folder: str) -> tuple[str, dict]:
    """Name and content of the last whole manifest; one that is not whole is of a writer that crashed or is at it."""
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    for name in reversed([n for n in names(spark, folder) if n.startswith("manifest-")]):
        p, fs = _fs(spark, f"{folder}/{name}")
        stream = fs.open(p)
        try:
            return name, json.loads(text.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            continue
        finally:
            stream.close()
    return "", {"segments": [], "id": "id"}


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The number of the last manifest, whole or not, and the content of the last whole one."""
    found = [n for n in names(spark, folder) if n.startswith("manifest-")]
    return int(found[-1].removeprefix("manifest-")) if found else 0, _latest(spark, folder)[1]


def _publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """A manifest is made by an exclusive create, so of two writers of one number one fails; readers pass over one that is not
    whole."""
    at, fs = _fs(spark, f"{folder}/manifest-{number:012d}")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        raise RuntimeError(f"another writer changed {folder}: nothing of this upsert counts, try again") from e
    stream.write(json.dumps(content).encode())
    stream.close()


def _read(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """Each segment without the ids of the later ones."""
    parts, later = [], None
    for segment in reversed(manifest["segments"]):
        rows = spark.read.parquet(f"{folder}/{segment}")
        parts.append(rows if later is None else rows.join(later, manifest["id"], "left_anti"))
        own = rows.select(manifest["id"])
        later = own if later is None else later.unionByName(own)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def create(spark: SparkSession, table: str, persona: str, schema: str, id_: str = "id") -> None:
    """An empty collection, if there is none."""
    if not exists(spark, _folder(table, persona)):
        upsert(table, spark.createDataFrame([], schema + ", batch int"), persona, id_)


def upsert(table: str, rows: DataFrame, persona: str, id_: str = "id") -> int:
    """Writes rows into a persona's collection: the same id is replaced, nothing else goes; rows come with a batch order
    column `batch`, the last of an id wins. Returns the rows seen before ids were made unique. rows runs once."""
    spark = rows.sparkSession
    folder = _folder(table, persona)
    number, manifest = _manifest(spark, folder)
    seen = Observation()
    segment = f"segment-{uuid.uuid4().hex}"
    latest(rows.observe(seen, F.count(F.lit(1)).alias("n")), id_, "batch").write.parquet(f"{folder}/{segment}")
    new = {"segments": [*manifest["segments"], segment], "id": id_}
    if len(new["segments"]) > SEGMENTS:
        merged = f"segment-{uuid.uuid4().hex}"
        _read(spark, folder, new).write.parquet(f"{folder}/{merged}")
        new["segments"] = [merged]
    _publish(spark, folder, number + 1, new)
    return seen.get["n"]


def vacuum(spark: SparkSession, table: str, persona: str) -> int:
    """Deletes what the last manifest does not list, and returns how many folders and files went; readers that began
    before it was published must be done."""
    folder = _folder(table, persona)
    last, manifest = _latest(spark, folder)
    gone = [n for n in names(spark, folder) if n not in manifest["segments"] and not n.startswith("manifest-") or n.startswith("manifest-") and n < last]
    for n in gone:
        p, fs = _fs(spark, f"{folder}/{n}")
        fs.delete(p, True)
    return len(gone)


def personas(spark: SparkSession, table: str) -> list[str]:
    return [n for n in names(spark, table) if _manifest(spark, _folder(table, n))[0]]


def collection(spark: SparkSession, table: str, persona: str | None = None) -> DataFrame:
    """All rows of a persona, or of all, with the persona's name."""
    some = [persona] if persona is not None else personas(spark, table)
    parts = [_read(spark, _folder(table, p), _manifest(spark, _folder(table, p))[1]).withColumn("persona", F.lit(p)) for p in some]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def export_jsonl(rows: DataFrame, path: str, most: int = 0) -> None:
    (rows.limit(most) if most else rows).write.json(path)
