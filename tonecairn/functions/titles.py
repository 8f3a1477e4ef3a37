"""What a patch is called on a device whose browser shows one flat list of short rows: labels of its folders before its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels as L
from . import vocabulary as V

# The longest label that is spelled out, and the characters that a row of the browser shows.
SPELLED_OUT, ROW = 11, 18


def label_text(part: Column) -> Column:
    """A folder's name without its number, a number being one or two digits before a blank; words in capitals, of four letters or more, become capitalised."""
    bare = F.trim(F.regexp_replace(part, r"^\d{1,2}\s*[.\-_)]?\s+", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    calm = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}{4,}$"), F.concat(F.left(w, F.lit(1)), F.lower(F.substring(w, 2, 1_000_000)))).otherwise(w))
    return F.array_join(calm, " ")


def spoken(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(L.SPOKEN), 0)


def initials(label: Column) -> Column:
    """First letters of a label's words as capitals; words that begin with a digit stay whole."""
    return F.array_join(F.transform(spoken(label), lambda w: F.when(w.rlike("^[0-9]"), w).otherwise(F.upper(F.left(w, F.lit(1))))), "")


def abbreviated(label: Column) -> Column:
    """Initials of a long label of several words."""
    return F.when((F.length(label) <= SPELLED_OUT) | (F.size(spoken(label)) < 2), label).otherwise(initials(label))


def fresh_labels(folders: Column) -> Column:
    """Labels of folders, the outermost first, each without the words that those before it said; a label with nothing new is left out."""
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("used"), nothing.alias("labels"))

    def add(state: Column, folder: Column) -> Column:
        words = spoken(label_text(folder))
        new = F.filter(words, lambda w: ~F.array_contains(state["used"], F.lower(w)))
        return F.struct(
            F.array_union(state["used"], F.transform(words, lambda w: F.lower(w))).alias("used"),
            F.when(F.size(new) > 0, F.concat(state["labels"], F.array(F.array_join(new, " ")))).otherwise(state["labels"]).alias("labels"),
        )

    return F.aggregate(folders, start, add, lambda state: state["labels"])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named; a repeated expression is computed each time inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ladder(labels: Column, name: Column) -> Column:
    """The name behind the last label, the last two, and so on, from the longest that fits a row; the first if none does."""
    runs = F.transform(F.sequence(F.size(labels), F.lit(1)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), " "), F.lit(" - "), name))

    def from_the_longest(runs: Column) -> Column:
        fitting = F.filter(F.sequence(F.lit(1), F.size(runs)), lambda k: F.length(F.element_at(runs, k)) <= ROW)
        return F.slice(runs, F.coalesce(F.array_max(fitting), F.lit(1)), F.size(runs))

    return F.when(F.size(labels) > 0, _with(runs, from_the_longest)).otherwise(F.array().cast("array<string>"))


def candidates(labels: Column, name: Column) -> Column:
    """Titles that a patch could have, the shortest first; ``name`` is free of the labels' echo.

    Labels whose words are all tags say nothing that the tag filter doesn't, so
    titles without them come first, and those with all labels after. Neither a
    name nor a label is ever clipped.
    """
    both = F.transform(labels, lambda x: F.struct(abbreviated(x).alias("short"), V.said_by_tags(x).alias("tags")))

    def ladders(both: Column) -> Column:
        short, telling = F.transform(both, lambda x: x["short"]), F.transform(F.filter(both, lambda x: ~x["tags"]), lambda x: x["short"])
        return F.array_union(_with(telling, lambda x: _ladder(x, name)), _with(short, lambda x: _ladder(x, name)))

    titles = _with(both, ladders)
    return F.transform(F.when(F.size(labels) > 0, titles).otherwise(F.array(name)), lambda t: L.spaced(L.path_component(t)))


def with_titles(patches: DataFrame, folders: Column, name: Column, titles: str = "titles") -> DataFrame:
    """``patches`` with their candidates, from the folders of a patch, the outermost first, and its own name."""
    labelled = patches.withColumn("_labels", fresh_labels(folders)).withColumn("_free", L.without_echo(name, F.col("_labels")))
    named = labelled.withColumn("_free", F.when(F.col("_free") != "", F.col("_free")).otherwise(name))
    return named.withColumn(titles, candidates(F.col("_labels"), F.col("_free"))).drop("_labels", "_free")
