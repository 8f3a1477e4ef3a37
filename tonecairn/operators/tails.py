"""For every path the other one that shares the longest tail of parts with it, by order instead of by all tails.

Paths are turned round, so that what they share is a beginning, and sorted: the
paths that share a tail are next to each other. A task has a range of them and
finds there, for each path, the longest tail that a neighbour shares and the
first path among all that have it. A tail that goes on beyond a range is also one
of the tails of the range's first or last path; only those are exchanged between
ranges, a few dozen rows for each. So a path is moved for the sort and for its
range, and not once for each of its parts.
"""

from __future__ import annotations

import bisect
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def shared(a: list[str], b: list[str]) -> int:
    """How many parts two turned paths begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def neighbours(turned: list[list[str]]) -> list[int]:
    """Parts that each turned path of a sorted list shares with the one before it; 0 for the first."""
    return [0] + [shared(a, b) for a, b in zip(turned, turned[1:])]


class Least:
    """The two smallest values of any stretch of a list."""

    def __init__(self, values: list[str]) -> None:
        self.levels = [[(v,) for v in values]]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append([two(a + b) for a, b in zip(last, last[width:])])
            width *= 2

    def between(self, start: int, stop: int) -> tuple[str, ...]:
        k = (stop - start).bit_length() - 1
        return two(self.levels[k][start] + self.levels[k][stop - (1 << k)])


def two(values: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted(set(values))[:2])


class Range:
    """Sorted turned paths of one range."""

    def __init__(self, paths: list[str], parts: list[list[str]]) -> None:
        self.parts, self.with_last = parts, neighbours(parts)
        self.least = Least(paths) if paths else None

    def _end(self, i: int, k: int, step: int) -> int:
        """How far paths that share ``k`` parts reach from path ``i``, up or down."""
        n = len(self.parts)
        head = self.parts[i][:k]
        # sorted lists: all that begin with head are together
        if step < 0:
            return bisect.bisect_left(self.parts, head, 0, i, key=lambda p: p[:k])
        return bisect.bisect_right(self.parts, head, i, n, key=lambda p: p[:k])

    def of_tail(self, i: int, k: int) -> tuple[str, ...]:
        return self.least.between(self._end(i, k, -1), self._end(i, k, 1))

    def border_tails(self) -> dict[tuple[str, ...], tuple[str, ...]]:
        """For every tail of the first and the last path the two smallest paths of the range that have it."""
        return {tuple(self.parts[i][:k]): self.of_tail(i, k) for i in {0, len(self.parts) - 1} for k in range(1, len(self.parts[i]) + 1)}


_SEPARATOR = "\x01"  # sorts before what paths have in them


def longest_shared_tails(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, found, parts) for every row that shares a last part with another row's path, in whatever case: of the paths that share the longest tail the smallest.

    ``key`` tells rows apart. Rows of one path share all of it; null paths are left out.
    """
    rows = files.where(F.col(path).isNotNull()).select(key, F.col(path).alias("path"))
    turned = F.array_join(F.reverse(F.split(F.lower("path"), "/")), _SEPARATOR)
    rows = rows.withColumn("turned", turned)
    spelled = rows.groupBy("turned", "path").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    # the spellings of one path differ in case only, so they are few
    same = spelled.groupBy("turned").agg(F.array_sort(F.collect_list(F.struct("path", "low", "high"))).alias("spellings"), F.min("low").alias("low"), F.max("high").alias("high"))
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = same.select("turned", F.get("spellings", F.lit(0))["path"].alias("path"), (F.col("low") < F.col("high")).alias("again")).repartitionByRange(width, "turned").sortWithinPartitions("turned")
    placed = cut(dealt.withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33).cast("int")))

    def read(table: pa.Table) -> tuple[list[tuple[str, bool]], Range]:
        rows = zip(*(table.column(c).to_pylist() for c in ("turned", "path", "again")), strict=True)
        order = sorted((t.split(_SEPARATOR), t, p, again) for t, p, again in rows)
        return [(t, again) for _, t, _, again in order], Range([p for _, _, p, _ in order], [parts for parts, *_ in order])

    def borders(table: pa.Table) -> pa.Table:
        tails = read(table)[1].border_tails()
        columns = {"range": ([table.column("range")[0].as_py()] * len(tails), pa.int32()), "tail": ([_SEPARATOR.join(t) for t in tails], pa.string()), "least": ([list(v) for v in tails.values()], pa.list_(pa.string()))}
        return pa.table({c: pa.array(v, t) for c, (v, t) in columns.items()})

    ends = cut(placed.groupBy("range").applyInArrow(borders, "range int, tail string, least array<string>"))
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, 2)
    beyond = ends.groupBy("tail").agg(F.count_distinct("range").alias("ranges"), least.alias("all")).where("ranges > 1")
    crossing = ends.join(beyond, "tail").select("range", "tail", "all")

    def settle(table: pa.Table, outside: pa.Table) -> pa.Table:
        names, own = read(table) if table.num_rows else ([], Range([], []))
        known = {tuple(t.split(_SEPARATOR)): v for t, v in zip(outside.column("tail").to_pylist(), outside.column("all").to_pylist(), strict=True)}
        depths = sorted({len(t) for t in known}, reverse=True)
        out: tuple[list, list, list] = ([], [], [])
        for i, parts in enumerate(own.parts):
            near = max(own.with_last[i], own.with_last[i + 1] if i + 1 < len(own.parts) else 0)
            name, again = names[i]
            k = len(parts) if again else max(near, next((d for d in depths if d <= len(parts) and tuple(parts[:d]) in known), 0))
            if k:
                for column, value in zip(out, (name, k, known.get(tuple(parts[:k])) or list(own.of_tail(i, k))), strict=True):
                    column.append(value)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("turned", "parts", "least"), out, (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)})

    found = placed.groupBy("range").cogroup(crossing.groupBy("range")).applyInArrow(settle, "turned string, parts long, least array<string>")
    mine = lambda s: (s["low"] == F.col(key)) & (s["high"] == F.col(key))
    all_ = rows.join(same.select("turned", "spellings"), "turned").join(found, "turned")
    own = F.get(F.filter("spellings", lambda s: ~mine(s)), F.lit(0))["path"]  # another row of the same path
    other = F.get(F.filter("least", lambda p: F.lower(p) != F.lower(F.col("path"))), F.lit(0))
    return all_.select(key, F.least(own, other).alias("found"), "parts").where("found IS NOT NULL")
