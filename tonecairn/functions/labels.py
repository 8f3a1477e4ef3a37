"""Column expressions over names, labels and paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve note names, with their place in the octave.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# Flats that file names use, with the sharps they equal.
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}


def note_name(note: Column) -> Column:
    """C4 is 60."""
    names = F.array(*(F.lit(n) for n in NOTES))
    return F.concat(F.element_at(names, F.pmod(note, F.lit(12)).cast("int") + 1), (F.floor(note / 12) - 1).cast("string"))


def note_of(letter: Column, octave: Column) -> Column:
    """The MIDI number; null if the letter is no note or the number lies outside 0..127."""
    places = F.create_map(*(F.lit(x) for i, n in enumerate(NOTES) for x in (n, i)), *(F.lit(x) for f, s in FLATS.items() for x in (f, NOTES.index(s))))
    number = (octave + 1) * 12 + F.try_element_at(places, letter)
    return F.when(number.between(0, 127), number)


# Where a file's stem has its note, in the order in which the shapes are tried, whatever the case of letters.
# Groups: note, octave, take. First before a hash at the end, then at the end, then at the start.
NOTE_SHAPES = (
    r"_([A-G][#b]?)(-?\d+)(?:_(\d+))?-[A-Za-z0-9]+$",
    r"(?:^|(?<=[^A-Za-z]))([A-G][#b]?)(-?\d+)(?:[_ ](\d+))?$",
    r"^([A-G][#b]?)(-?\d+)(?:_(\d+))?(?![A-Za-z0-9])",
)


def parsed_note(stem: Column) -> Column:
    """Note, take and whether a number gave the take, of a file's stem; the first shape that it has decides, and a note outside 0..127 is none. Without a take it is the first."""
    part = lambda k: F.coalesce(*(F.when(stem.rlike("(?i)" + s), F.regexp_extract(stem, "(?i)" + s, k)) for s in NOTE_SHAPES))
    letter = F.concat(F.upper(F.substring(part(1), 1, 1)), F.lower(F.substring(part(1), 2, 1)))
    note = note_of(letter, part(2).try_cast("long"))
    return F.when(note.isNotNull(), F.struct(note.cast("int").alias("note"), F.coalesce(part(3).try_cast("int"), F.lit(1)).alias("take"), part(3).try_cast("int").isNotNull().alias("numbered")))


# What a word is made of, and white space, in Unicode's terms.
_NOT_WORD = r"[^\p{L}\p{N}_]"
_BLANKS = r"[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]+"


def sanitised(name: Column) -> Column:
    """Characters other than letters and digits of any script and _ become one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, _NOT_WORD, "_"), "_+", "_"), "^_|_$", "")


def spaced(name: Column) -> Column:
    """Full stops as blanks, white space as one blank."""
    return F.trim(F.regexp_replace(F.replace(name, F.lit("."), F.lit(" ")), _BLANKS, " "))


def path_component(name: Column) -> Column:
    """A name that is one component of a path: no white space around it, separators as _."""
    return F.translate(F.regexp_replace(name, f"^{_BLANKS}|{_BLANKS}$", ""), "/\\", "__")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words, with camelCase parted."""
    parted = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda t: t != "")


# What a word of a label is made of.
SPOKEN = "[0-9A-Za-z']+"
_spoken = re.compile(SPOKEN)


def _echoes(said: list[tuple[str, int, int]], run: list[str], size: int) -> list[tuple[int, int]]:
    """Where a name of ``size`` characters and the words ``said`` (word, start, stop) says ``run``; a run of one word counts at the name's ends only."""
    if len(said) <= len(run):
        return []
    if len(run) > 1:
        words, found, at = [w for w, _, _ in said], [], 0
        while at + len(run) <= len(words):
            if words[at : at + len(run)] == run:
                found.append((said[at][1], said[at + len(run) - 1][2]))
                at += len(run)
            else:
                at += 1
        return found
    (first, start, _), (last, _, stop) = said[0], said[-1]
    if first == run[0]:
        return [(0, said[1][1])] if start == 0 else []
    return [(said[-2][2], size)] if last == run[0] and stop == size else []


def _echo_free(name: str | None, labels: list[str]) -> str | None:
    """``name`` without the longest beginning of each label that it says, label by label."""
    for label in labels if name is not None else ():
        run = _spoken.findall(label.lower())
        while run:
            said = [(m[0].lower(), m.start(), m.end()) for m in _spoken.finditer(name)]
            kept, at = [], 0
            for start, stop in _echoes(said, run, len(name)):
                kept.append(name[at:start])
                at = stop
            left = re.sub(r"\s{2,}", " ", "".join(kept) + name[at:]).strip(" -_") if at else ""
            if left and left != name:
                name = left
                break
            run.pop()
    return name


def without_echo(name: Column, labels: Column) -> Column:
    """``name`` without what ``labels``, an array, already say."""

    @F.pandas_udf("string")
    def run(names: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_echo_free(n, [] if own_labels is None else list(own_labels)) for n, own_labels in zip(names, own, strict=True)], dtype=object)

    return run(name, labels)


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def xml_unescaped(text: Column) -> Column:
    out = text
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(name), F.lit(raw))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def content_key(*parts: Column, digits: int = 32) -> Column:
    """Leading hexadecimal digits of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, digits)
