"""Writers: tag index and preset documents as XML, plans as JSON lines, conformed WAV bytes."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import xml_escaped, xml_unescaped
from . import riff


def index_lines(index: DataFrame) -> DataFrame:
    """One XML element per patch of (path, tags), ordered by path when written with ``orderBy('path')``."""
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<tag>"), xml_escaped(t), F.lit("</tag>"))), "")
    return index.select("path", F.concat(F.lit('<patch path="'), xml_escaped(F.col("path")), F.lit('">'), tags, F.lit("</patch>")).alias("value"))


def read_index_lines(lines: DataFrame) -> DataFrame:
    """The inverse of ``index_lines``."""
    path = xml_unescaped(F.regexp_extract("value", 'path="([^"]*)"', 1))
    tags = F.transform(F.regexp_extract_all("value", F.lit("<tag>([^<]*)</tag>"), 1), xml_unescaped)
    return lines.select(path.alias("path"), tags.alias("tags"))


def preset_document(name: str, zones: list[dict]) -> str:
    """A multisample document: one range per zone, in the order of roots; unlooped zones end at their last frame."""
    root = ElementTree.Element("preset", name=name)
    for z in sorted(zones, key=lambda z: (z["root"], z.get("vel_low", 0), z["file"])):
        zone = ElementTree.SubElement(root, "zone", file=z["file"], root=str(z["root"]), low=str(z.get("key_low", z["root"])), high=str(z.get("key_high", z["root"])))
        if z.get("loop_start") is not None:
            zone.set("loopStart", str(z["loop_start"]))
            zone.set("loopEnd", str(z["loop_stop"]))
    return ElementTree.tostring(root, encoding="unicode")


def preset_documents(zones: DataFrame) -> DataFrame:
    """(preset, document) of zones (preset, file, root, key_low, key_high, vel_low, loop_start, loop_stop), made in the JVM."""
    z = F.struct("root", "vel_low", "file", "key_low", "key_high", "loop_start", "loop_stop")
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))
    element = lambda s: F.concat(
        F.lit("<zone"), F.lit(' file="'), xml_escaped(s["file"]), F.lit('"'), attribute("root", s["root"]), attribute("low", F.coalesce(s["key_low"], s["root"])),
        attribute("high", F.coalesce(s["key_high"], s["root"])), F.coalesce(F.concat(attribute("loopStart", s["loop_start"]), attribute("loopEnd", s["loop_stop"])), F.lit("")), F.lit(" />"),
    )
    rows = zones.groupBy("preset").agg(F.array_sort(F.collect_list(z)).alias("zones"))
    return rows.select("preset", F.concat(F.lit('<preset name="'), xml_escaped(F.col("preset")), F.lit('">'), F.array_join(F.transform("zones", element), ""), F.lit("</preset>")).alias("document"))


def conformed(files: DataFrame) -> DataFrame:
    """(path, content, ratio, error) of WAV bytes (path, content) as the default device plays them."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, ratios, errors = [], [], []
            for raw in batch.column("content").to_pylist():
                try:
                    out, ratio = riff.conform(raw)
                    contents.append(out), ratios.append(ratio), errors.append(None)
                except ValueError as e:
                    contents.append(None), ratios.append(None), errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary()), pa.array(ratios, pa.float64()), pa.array(errors, pa.string())], names=["path", "content", "ratio", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, ratio double, error string")
