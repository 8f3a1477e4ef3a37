"""Data sources for Spark: libraries of samples, read no further than a sink plays them, and folders of presets that appear whole or not at all.

``register`` makes both known to a session::

    spark.read.format("sample_library").option("path", folder).load().where("note between 36 and 60 and take = 1")
    files.write.format("preset_folders").option("path", folder).mode("append").save()
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions import labels as L
from . import riff
from .readers import file_system

SAMPLES = "folder string, file string, note int, velocity int, take int, channels int, rate int, bits int, frames long, loop_start long, loop_end long, error string"
_NAMED = ("note", "velocity", "take")  # what a file's name says
_LAYER = re.compile(r"^(.*)_V(\d+)_RR(\d+)$", re.I)
_DEFAULT_VELOCITY, _PUSHDOWN = 100, "spark.sql.python.filterPushdown.enabled"


def named(stem: str) -> dict[str, int | None]:
    """Note, velocity and take that a stem gives; 100 and 1 where it says no velocity and no take."""
    layer = _LAYER.match(stem)
    stem, velocity, take = (layer[1], int(layer[2]), int(layer[3])) if layer else (stem, _DEFAULT_VELOCITY, None)
    for shape in L.NOTE_SHAPES:
        if found := re.search(shape, stem, re.I):
            letter = found[1][0].upper() + found[1][1:].lower()
            number = (int(found[2]) + 1) * 12 + L.NOTES.index(L.FLATS.get(letter, letter)) if L.FLATS.get(letter, letter) in L.NOTES else -1
            return {"note": number if 0 <= number <= 127 else None, "velocity": velocity, "take": take or (int(found[3]) if found[3] else 1)}
    return {"note": None, "velocity": velocity, "take": take or 1}


_COMPARED = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass(frozen=True)
class Wanted:
    """A condition on what a name says."""

    column: str
    kind: type
    value: object

    def holds(self, name: dict) -> bool:
        have = name[self.column]
        if self.kind is IsNotNull:
            return have is not None
        if have is None:
            return self.kind is EqualNullSafe and self.value is None
        return self.value is not None and _COMPARED[self.kind](have, self.value)


class LibraryReader(DataSourceReader):
    """One partition for every folder. Conditions on note, velocity and take are decided by names, and a file that they leave out is not opened."""

    def __init__(self, options: dict) -> None:
        self.root, self.wanted = options["path"], ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            attribute = getattr(f, "attribute", ())  # a condition made of others has none
            column = attribute[0] if len(attribute) == 1 else ""
            if column in _NAMED and (type(f) in _COMPARED or isinstance(f, IsNotNull)):
                self.wanted += (Wanted(column, type(f), tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)),)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.root)
        below = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [InputPartition(p) for p in sorted({root, *(f.path for f in below if f.type == fs.FileType.Directory)})]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = file_system(self.root)
        folder = partition.value
        for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path):
            stem, dot, end = info.base_name.rpartition(".")
            if not info.is_file or end.lower() != "wav" or stem.startswith("."):
                continue
            name = named(stem)
            if not all(w.holds(name) for w in self.wanted):
                continue
            with system.open_input_stream(info.path, compression=None) as f:
                raw = f.read()
            form, body = riff.wav_format(raw), riff.chunk(raw, b"data")
            said = (folder[len(root) :].strip("/"), info.path, name["note"], name["velocity"], name["take"])
            if form is None or body is None:
                yield (*said, *[None] * 6, "no WAV file")
            else:
                yield (*said, form.channels, form.rate, form.bits, len(body) // max(1, form.channels * form.bits // 8), *(riff.loop_points(raw) or (None, None)), None)


class SampleLibrary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_library"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(self.options)


@dataclass(frozen=True)
class Plays:
    """What a sink can play of a set: all velocity layers or one, all takes or one; a kit's pad one note."""

    layers: bool = False
    takes: int = 1
    notes: bool = True

    def velocities_used(self, velocities: list[int], target: int = _DEFAULT_VELOCITY) -> list[int]:
        """All, or the one that is nearest to the target, the louder of two that are as near."""
        return sorted(velocities) if self.layers or not velocities else [min(velocities, key=lambda v: (abs(v - target), -v))]

    def notes_used(self, notes: list[int], middle: int = 60) -> list[int]:
        return sorted(notes) if self.notes or not notes else [min(notes, key=lambda n: (abs(n - middle), n))]

    def condition(self, velocities: list[int], notes: list[int]) -> Column:
        """What a reader need not go beyond."""
        return F.col("velocity").isin(*self.velocities_used(velocities)) & F.col("note").isin(*self.notes_used(notes)) & (F.col("take") <= self.takes)


# what each device asks for
SINKS = {"deluge": Plays(), "deluge_kit": Plays(notes=False), "bento": Plays(layers=True), "bento_kit": Plays(notes=False)}


def for_sink(library: DataFrame, sink: str, velocities: list[int], notes: list[int]) -> DataFrame:
    """The samples of a library that a sink plays, of the velocities and notes that a plan wants."""
    return library.where(SINKS[sink].condition(velocities, notes))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    presets: tuple[str, ...]


class PresetWriter(DataSourceWriter):
    """Rows (preset, file, content) as folders of files. A task writes to a hidden folder of its own; the commit moves whole presets to their places."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.stage = options["path"], overwrite, f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = file_system(self.root)
        folder, presets = posixpath.join(root, self.stage, uuid.uuid4().hex), set()
        for row in iterator:
            parts = [p for p in f"{row['preset']}/{row['file']}".split("/") if p not in ("", ".", "..")]
            path = posixpath.join(folder, *parts)
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(path, compression=None) as f:
                f.write(bytes(row["content"] or b""))
            presets.add("/".join(p for p in row["preset"].split("/") if p not in ("", ".", "..")))
        return Staged(folder, tuple(sorted(presets)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.root)
        staged = [(preset, m.folder) for m in messages if m is not None for preset in m.presets]
        if len({p for p, _ in staged}) < len(staged):
            self.abort(messages)
            raise ValueError("files of one preset were written by several tasks: repartition by preset")
        there = {i.path for i in system.get_file_info([posixpath.join(root, p) for p, _ in staged]) if i.type != fs.FileType.NotFound}
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"presets are there already: {sorted(there)[:3]}")
        for preset, folder in staged:
            place = posixpath.join(root, preset)
            if place in there:
                system.delete_dir(place)
            system.create_dir(posixpath.dirname(place), recursive=True)
            system.move(posixpath.join(folder, preset), place)
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*file_system(self.root))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        stage = posixpath.join(root, self.stage)
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


class PresetFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "preset_folders"

    def schema(self) -> str:
        return "preset string, file string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PresetWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``sample_library`` and ``preset_folders`` known to a session, which is to push conditions down to Python sources."""
    spark.dataSource.register(SampleLibrary)
    spark.dataSource.register(PresetFolders)
    spark.conf.set(_PUSHDOWN, "true")


def write_presets(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write rows (preset, file, content) so that every preset appears at once, or none if the job fails."""
    register(files.sparkSession)
    rows = files.select("preset", "file", "content").repartition("preset")
    rows.write.format("preset_folders").option("path", folder).mode("overwrite" if overwrite else "append").save()


def write_documents(documents: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Preset documents (preset, path, document, error), as the devices' builders make them: the folder of ``path`` is the preset's."""
    good = documents.where(F.col("error").isNull())
    place, name = F.regexp_replace("path", "/?[^/]*$", ""), F.regexp_extract("path", "([^/]*)$", 1)
    write_presets(good.select(place.alias("preset"), name.alias("file"), F.col("document").cast("binary").alias("content")), folder, overwrite)
