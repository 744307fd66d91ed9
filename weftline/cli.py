"""Command line: network file in, detector file and optionally GeoJSON out."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.zones import diagnostics_of, lane_reasons, zones_of
from weftline.schemas import NetworkFrames
from weftline.sinks import staged, write_detectors, write_geojson
from weftline.sources.network import frames_of, scan_network, scan_tags, tables_of_tags

# Suffixes of the files that are read and written, and what is said when one is written.
NET_SUFFIX, OUT_SUFFIX = ".net.xml", ".waiting-zones.add.xml"
GEOJSON_WRITTEN, DETECTORS_WRITTEN = "GeoJSON written successfully: %s", "Processing completed successfully: %s"
#: A file of more bytes than this is read by several tasks.
LARGE_BYTES = 256 << 20


@dataclass(frozen=True)
class Config:
    input: Path
    output: Path
    max_zone_length: float | None = None
    geojson_output: Path | None = None


def default_output(source: Path) -> Path:
    """Beside the input: its name without .net.xml, or else without its last extension."""
    name = source.name or "output"
    stem = name.removesuffix(NET_SUFFIX) if name.endswith(NET_SUFFIX) else Path(name).stem
    return source.with_name(stem + OUT_SUFFIX) if source.name else source / (stem + OUT_SUFFIX)


def parse_args(argv: list[str] | None = None) -> Config:
    parser = argparse.ArgumentParser(prog="weftline", description="Derive queueing zones of signalised junctions from a road network.")
    parser.add_argument("input", type=Path, help="network file (.net.xml)")
    parser.add_argument("-o", "--output", type=Path, help="detector file to write")
    parser.add_argument("--max-zone-length", type=float, metavar="METERS", help="longest zone before the stop line")
    parser.add_argument("--geojson", type=Path, metavar="PATH", help="also write the zones as GeoJSON")
    raw = parser.parse_args(argv)
    return Config(raw.input, raw.output or default_output(raw.input), raw.max_zone_length, raw.geojson)


def run(config: Config, spark: SparkSession) -> None:
    """GeoJSON comes first: if it fails, no detector file appears.

    What becomes of each lane is worked out once and staged, partitioned by whether the
    lane is grouped; zones and diagnostics are read from there."""
    large = config.input.is_file() and config.input.stat().st_size > LARGE_BYTES
    scan = (scan_tags if large else scan_network)(spark, str(config.input)).persist()
    try:
        if not large and scan.count() > 1:
            raise ValueError(f"several networks at {str(config.input)!r}: a document is of one network")
        net = tables_of_tags(scan) if large else frames_of(scan)
        with staged(spark) as folder:
            lanes = lane_reasons(net)
            lanes.withColumn("grouped", F.col("reason").isNull()).write.partitionBy("grouped").parquet(f"{folder}/lanes")
            lanes = spark.read.schema(lanes.schema.add("grouped", "boolean")).parquet(f"{folder}/lanes")
            _write(config, net, zones_of(lanes.where("grouped"), config.max_zone_length), diagnostics_of(lanes.where("NOT grouped")))
    finally:
        scan.unpersist()


def _write(config: Config, net: NetworkFrames, zones: DataFrame, diagnostics: DataFrame) -> None:
    for row in diagnostics.orderBy("junction_pos", "inc_pos").select("message").toLocalIterator():
        warn(row["message"])
    if config.geojson_output is not None:
        write_geojson(zones, net, config.geojson_output)
        print(GEOJSON_WRITTEN % repr(str(config.geojson_output)))
    write_detectors(zones, config.output)
    print(DETECTORS_WRITTEN % repr(str(config.output)))


def warn(message: str) -> None:
    bold, plain = ("\033[1;33m", "\033[0m") if sys.stderr.isatty() else ("", "")
    print(f"{bold}warning:{plain} {message}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    config = parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    try:
        run(config, spark)
    except Exception as error:  # the process reports any failure by its exit code
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
