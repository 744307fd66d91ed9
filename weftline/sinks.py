"""Documents: the detector file (XML) and the map (GeoJSON), with their rows as text.

Executors write the text of every element or feature, indented, in the document's
order: dealt by range of the order and sorted within, one file for each range.  The
driver then joins the files by copying their bytes between a head and a tail, a
block at a time.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import plain_number, plain_position
from weftline.operators.features import ZONE, check_observed, zone_features
from weftline.schemas import NetworkFrames

# The folder in which a simulator puts what a detector has seen, and the names of a feature's properties.
OUTPUT_FOLDER = "detector_output"
ID_PROPERTY, STOP_PROPERTY = "waiting_zone_id", "stop_line"

ORDER = ZONE
_XML_HEAD, _XML_TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<additional>\n', "</additional>\n"
_JSON_HEAD, _JSON_TAIL = '{\n  "type": "FeatureCollection",\n  "features": [', "\n  ]\n}\n"
_BLOCK = 1 << 16


def output_file(zone_id):
    return F.concat(F.lit(f"{OUTPUT_FOLDER}/"), zone_id, F.lit(".xml"))


def detector_rows(zones: DataFrame) -> DataFrame:
    """Rows as the XML writer takes them: attributes begin with an underscore, null ones are left out."""

    def gates(column):
        position = lambda g: F.when(g.from_end, F.concat(F.lit("-"), plain_number(g.pos))).otherwise(plain_number(g.pos))
        return F.transform(column, lambda g: F.struct(g.lane.alias("_lane"), position(g).alias("_pos"), g.friendly.cast("string").alias("_friendlyPos")))

    return zones.select(
        *ORDER,
        F.col("zone_id").alias("_id"),
        output_file(F.col("zone_id")).alias("_file"),
        F.when(F.col("icon").isNotNull(), plain_position(F.col("icon"))).alias("_pos"),
        gates("entries").alias("detEntry"),
        gates("exits").alias("detExit"),
    )


def _indented(text: Column) -> Column:
    """Every line four blanks further in; what is in an attribute or a string has no line feeds."""
    return F.concat(F.lit("    "), F.replace(text, F.lit("\n"), F.lit("\n    ")))


def detector_xml(zones: DataFrame) -> DataFrame:
    """The document's order, and each zone's element as indented text."""
    element = F.to_xml(F.struct("_id", "_file", "_pos", "detEntry", "detExit"), {"rowTag": "e3Detector"})
    return detector_rows(zones).select(*ORDER, _indented(element).alias("element"))


def _list_text(values: Column, depth: int, indent: int) -> Column:
    """JSON of lists of numbers, so deep, an item to a line; the line it begins on is indented so far."""
    if not depth:
        return values.cast("string")
    items = F.transform(values, lambda v: F.concat(F.lit(" " * (indent + 2)), _list_text(v, depth - 1, indent + 2)))
    return F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n" + " " * indent + "]"))


def _string_text(text: Column) -> Column:
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _feature_text() -> Column:
    """A feature as it stands in the document: two blanks a level, an item to a line."""
    parts = [
        *('    {\n      "type": "Feature",\n      "geometry": {\n        "type": "MultiPolygon",\n        "coordinates": ', _list_text(F.col("polygons"), 4, 8), "\n      },\n"),
        *(f'      "properties": {{\n        "{STOP_PROPERTY}": ', _list_text(F.col("stop_line"), 1, 8), f',\n        "{ID_PROPERTY}": ', _string_text(F.col("zone_id")), "\n      }\n    }"),
    ]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def feature_json(zones: DataFrame, net: NetworkFrames, digits: int | None = None, pretty: bool = False, seen: Observation | None = None) -> DataFrame:
    """The document's order, and one GeoJSON feature per row, as text; positions rounded to so many digits if given. pretty: as it stands in the document. seen: see lane_rectangles."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    properties = F.struct(F.col("stop_line").alias(STOP_PROPERTY), F.col("zone_id").alias(ID_PROPERTY))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return zone_features(zones, net, digits, seen).select(*ORDER, (_feature_text() if pretty else F.to_json(feature)).alias("feature"))


class WriteError(OSError):
    """A document that couldn't be written, with its path."""


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share; none is needed where all of Spark runs in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise WriteError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared


@contextlib.contextmanager
def staged(spark: SparkSession) -> Iterator[str]:
    """A folder for Spark's writers, removed afterwards: within the cluster's shared one, or one of our own where all of Spark runs in this process."""
    shared = shared_folder(spark)
    folder = f"{shared}/documents-{uuid.uuid4().hex}" if shared else Path(tempfile.mkdtemp(prefix="weftline-documents-")).as_uri()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        yield folder
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEAN_UP, _WRITERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def lean(spark: SparkSession, writers: int = 0) -> Iterator[None]:
    """What is written or kept within leaves no shuffle files behind, where Spark would wait for the driver's garbage collector. writers: a task that deals its rows to as many folders at most doesn't sort them for it."""
    settings = {_CLEAN_UP: "true"} | ({_WRITERS: str(writers)} if writers else {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def kept(frame: DataFrame) -> DataFrame:
    """frame materialised by a checkpoint, in the cluster's shared folder or one of our own where all of Spark runs in this process; what it was made from may go."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark) or tempfile.mkdtemp(prefix="weftline-checkpoints-"))
    return frame.checkpoint()


@contextlib.contextmanager
def _writing(path: Path) -> Iterator[None]:
    try:
        yield
    except OSError as error:
        raise WriteError(f"failed to write {str(path)!r}: {error}") from error


def _write_parts(rows: DataFrame, text: Column, folder: str) -> None:
    """The text of each row in a line or more, files in the document's order."""
    rows.orderBy(*ORDER).select(text.alias("value")).write.text(folder)


def _parts(spark: SparkSession, folder: str) -> list:
    """The files with text in them, in the document's order, as Hadoop lists them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return sorted((s for s in found if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())


def _join_parts(spark: SparkSession, files: list, path: Path, head: str, tail: str, without_last: int = 0) -> None:
    """head, the bytes of the files without the last so many, and tail."""
    hadoop = spark._jvm.org.apache.hadoop
    path.write_text(head, encoding="utf-8")
    out = spark._jvm.java.io.FileOutputStream(str(path), True)
    try:
        for file in files:
            source = file.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).open(file.getPath())
            try:
                hadoop.io.IOUtils.copyBytes(source, out, _BLOCK, False)
            finally:
                source.close()
    finally:
        out.close()
    if files and without_last:
        os.truncate(path, path.stat().st_size - without_last)
    with path.open("a", encoding="utf-8") as rest:
        rest.write(tail)


def write_detectors(zones: DataFrame, path: str | Path) -> None:
    """The zones of one network as one additional file."""
    spark, path = zones.sparkSession, Path(path)
    with _writing(path):
        path.parent.mkdir(parents=True, exist_ok=True)
        with staged(spark) as folder:
            _write_parts(detector_xml(zones), F.col("element"), f"{folder}/elements")
            _join_parts(spark, _parts(spark, f"{folder}/elements"), path, _XML_HEAD, _XML_TAIL)


def write_geojson(zones: DataFrame, net: NetworkFrames, path: str | Path) -> None:
    """The zones of one network as one feature collection. Lanes are checked in the same pass that makes the features; a missing one throws what was staged away, and no file appears."""
    spark, path = zones.sparkSession, Path(path)
    seen = Observation()
    features = feature_json(zones, net, pretty=True, seen=seen)
    with _writing(path):
        with staged(spark) as folder:
            _write_parts(features, F.concat("feature", F.lit(",")), f"{folder}/features")
            files = _parts(spark, f"{folder}/features")
            if files:  # without any zone Spark drops what would be observed
                check_observed(seen)
            path.parent.mkdir(parents=True, exist_ok=True)
            _join_parts(spark, files, path, _JSON_HEAD + "\n", _JSON_TAIL, without_last=2)
