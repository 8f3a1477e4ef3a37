"""Spark readers of sample files and mappings: ``binaryFile`` scans with an Arrow decoder, so files are never listed on the driver by Python."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import containers, mappings, programs, riff

HEADERS = "path string, codec int, channels int, rate int, bits int, extensible boolean, frames long, loop_start long, loop_end long, broken string"
ZONES = (
    "path string, file string, root int, key_low int, key_high int, vel_low int, vel_high int, gain_db double, pan double, tune_cents double, track boolean, reverse boolean, "
    "sample_start long, sample_stop long, loop_start long, loop_stop long, loop_fade_s double, group long, error string"
)
SAMPLES = "path string, sample_rate int, ch0 array<float>, ch1 array<float>, error string"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def wav_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per WAV file; columns but ``path`` are null if it is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                form, body, loop = riff.wav_format(raw), riff.chunk(raw, b"data"), riff.loop_points(raw)
                if form is None:
                    rows.append((path, *[None] * 8, "no WAV file"))
                    continue
                frames = len(body or b"") // max(1, form.channels * form.bits // 8)
                rows.append((path, form.codec, form.channels, form.rate, form.bits, form.extensible, frames, *(loop or (None, None)), ",".join(riff.violations(form))))
            yield _batch(rows, HEADERS)

    return _files(spark, folder, "*.[wW][aA][vV]").mapInArrow(run, HEADERS)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded stereo audio; a file that can't be decoded has an error and no audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rate, x = riff.decode(raw)
                    row = (path, rate, x[0].tolist(), x[1].tolist(), None)
                except ValueError as e:
                    row = (path, None, None, None, str(e))
                yield _batch([row], SAMPLES)

    return _files(spark, folder, "*.[wW][aA][vV]").mapInArrow(run, SAMPLES)


def plain_path(uri: str) -> str:
    """The path of a local file that Spark names; any other URI as it is."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def file_system(uri: str):
    """Arrow's file system for what Spark names by path or URI, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if uri.startswith("file:") or not colon:  # Spark's paths are not percent-encoded
        return fs.LocalFileSystem(), plain_path(uri)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{quote(rest, safe='/:@')}")


class Beside:
    """Files next to a mapping, by names whose case may differ; folders are listed once."""

    def __init__(self, uri: str) -> None:
        self.files, path = file_system(uri)
        self.folder, self.listed, self.below = path.rpartition("/")[0], {}, None

    def find(self, name: str) -> str | None:
        """The path of a file, each part of it as given or in another case."""
        from pyarrow import fs

        at = self.folder
        for part in name.replace("\\", "/").split("/"):
            if part == "..":
                at = at.rpartition("/")[0]
            elif part not in ("", "."):
                if at not in self.listed:
                    self.listed[at] = sorted(f.base_name for f in self.files.get_file_info(fs.FileSelector(at, allow_not_found=True)))
                names = self.listed[at]
                found = part if part in names else next((n for n in names if n.lower() == part.lower()), None)
                if found is None:
                    return None
                at = f"{at}/{found}"
        return at if self.files.get_file_info(at).type == fs.FileType.File else None

    def anywhere(self, name: str) -> str | None:
        """A file of that name, in any case, in the folder above or below it: the first by path."""
        from pyarrow import fs

        if self.below is None:
            found = self.files.get_file_info(fs.FileSelector(self.folder.rpartition("/")[0] or self.folder, recursive=True, allow_not_found=True))
            self.below = {f.base_name.lower(): f.path for f in sorted(found, key=lambda f: f.path, reverse=True) if f.type == fs.FileType.File}
        return self.below.get(name.lower())

    def read(self, name: str) -> bytes | None:
        path = self.find(name)
        if path is None:
            return None
        with self.files.open_input_stream(path, compression=None) as f:
            return f.read()


def _sfz_rows(uri: str, raw: bytes) -> list[dict]:
    beside = Beside(uri)
    text = lambda name: None if (found := beside.read(name)) is None else found.decode("utf-8", "replace")
    rows = mappings.sfz_zones(raw.decode("utf-8", "replace"), text, lambda file: riff.loop_points(beside.read(file) or b""))
    for z in rows:
        found = beside.find(z["file"])
        z["file"], z["error"] = (found, None) if found else (z["file"], "no such sample")
    return rows


def _program_rows(uri: str, raw: bytes) -> list[dict]:
    beside = Beside(uri)
    bases = ("", "../")

    def locate(path: str, absolute: bool) -> str | None:
        """As given beside the program, else by ever shorter ends of the path there and one folder up, else by its name anywhere there."""
        direct, ends = None if absolute else beside.find(path), programs.tails(path)
        direct = direct or next((found for base in bases for end in ends if (found := beside.find(base + end))), None)
        return direct or (beside.anywhere(ends[-1]) if ends else None)

    newer = raw[12:16] == programs.ITEM_CONTAINER
    return containers.container_zones(raw, locate) if newer else programs.program_zones(raw, locate)


def zones(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Zones of all SFZ texts (``*.sfz``), programs (``*.nki``) or else multisample archives of a folder.

    A mapping that can't be read gives one row with its error, and so does a zone of an SFZ text whose sample isn't there.
    Includes and samples are looked for next to the mapping; ``file`` of its zones is the path found.
    """
    parse = {".sfz": _sfz_rows, ".nki": _program_rows}.get(pattern.lower()[-4:], lambda uri, raw: mappings.multisample_zones(raw))
    names = [x.split()[0] for x in ZONES.split(", ")][1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, *(z.get(n) for n in names), z.get("error")) for z in parse(path, raw)]
                except Exception as e:  # one bad file must not end the scan
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield _batch(rows, ZONES)

    return _files(spark, folder, pattern).mapInArrow(run, ZONES)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ", 1) for x in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))
