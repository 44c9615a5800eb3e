"""Assigning the lines of large files to parts by bytes, without breaking lines.

`greedy_parts` is exact: a line opens a new part when the current part holds something and
the line would push it over the target. That rule is sequential along a file, so it is run
as a scan over blocks. What a block does to the free room of the open part is a step
function; functions of neighbouring blocks compose, so blocks are summarised in parallel,
summaries are combined level by level, and the resulting room at the start of each block is
handed back down. No task sees more than one block of lines or one node of summaries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.numbering import BLOCK, running_sum
from siftlake.session import ensure_checkpoint_dir

FAN_IN = 8  # a summary holds at most the lines of one part, so eight of them fit a task
TASKS = 4  # for each core, over which blocks are dealt out
_NODE = "file string, node bigint, total bigint, bounds binary, rooms binary, cuts binary"
_FULL = -(1 << 62)  # room before the first line: it always opens part 1


def _successors(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sizes, and for each line the one that opens the next part if this one opens a part."""
    ends = np.cumsum(sizes)
    return ends, np.maximum(np.searchsorted(ends, ends - sizes + target, side="right"), np.arange(1, len(sizes) + 1))


def _openings(sizes: np.ndarray, target: int, room: int) -> np.ndarray:
    """The lines of a block that open a part, from the room that the block begins with. The
    successors of the lines known so far are the next ones, each step as many again."""
    ends, following = _successors(sizes, target)
    n = len(sizes)
    opening = np.searchsorted(ends, [room], side="right")
    ahead = np.append(following, n)  # n stands for the end of the block
    while opening[-1] < n:
        opening = np.concatenate([opening, ahead[opening]])
        ahead = ahead[ahead]
    return opening[opening < n]


class _Step:
    """Room in, room out. Below bounds[i] the result is rooms[i] with cuts[i] new parts; from
    the last bound on, everything fits and the room shrinks by `total`."""

    def __init__(self, total, bounds, rooms, cuts):
        self.total, self.bounds, self.rooms, self.cuts = int(total), bounds, rooms, cuts

    @classmethod
    def of_lines(cls, sizes: np.ndarray, target: int) -> "_Step":
        ends, following = _successors(sizes, target)
        n = len(sizes)
        # Binary lifting: each step doubles how many parts ahead `last` looks, up to the block's last one.
        last = np.where(following < n, following, np.arange(n))
        cuts = (following < n).astype(np.int64)
        while True:
            further = last[last]
            if (further == last).all():
                break
            cuts, last = cuts + cuts[last], further
        rooms = target - (ends[-1] - (ends - sizes)[last])
        return cls(ends[-1], ends, rooms, cuts + 1).limited(target)

    def limited(self, target: int) -> "_Step":
        """Room never exceeds the target, so later steps cannot be reached; neighbouring steps
        with one result become one."""
        reach = int(np.searchsorted(self.bounds, target, side="right")) + 1
        bounds, rooms, cuts = self.bounds[:reach], self.rooms[:reach], self.cuts[:reach]
        differs = np.append((rooms[1:] != rooms[:-1]) | (cuts[1:] != cuts[:-1]), True)
        return _Step(self.total, bounds[differs], rooms[differs], cuts[differs])

    def apply(self, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.bounds, room, side="right")
        hit = at < len(self.bounds)
        at = np.minimum(at, len(self.bounds) - 1)
        return np.where(hit, self.rooms[at], room - self.total), np.where(hit, self.cuts[at], 0)

    def then(self, other: "_Step", target: int) -> "_Step":
        rooms, cuts = other.apply(self.rooms)
        return _Step(
            self.total + other.total,
            np.concatenate([self.bounds, other.bounds + self.total]),
            np.concatenate([rooms, other.rooms]),
            np.concatenate([self.cuts + cuts, other.cuts]),
        ).limited(target)

    def row(self, file, node):
        return (file, node, self.total, self.bounds.tobytes(), self.rooms.tobytes(), self.cuts.tobytes())

    @classmethod
    def from_row(cls, row) -> "_Step":
        load = lambda b: np.frombuffer(b, dtype=np.int64)
        return cls(row.total, load(row.bounds), load(row.rooms), load(row.cuts))


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "node", "total", "bounds", "rooms", "cuts"])


def _summaries(target: int):
    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("line_no")["size"].to_numpy(dtype=np.int64)
        return _frame([_Step.of_lines(sizes, target).row(key[0], key[1])])

    return summarise


def _combined(target: int):
    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = [_Step.from_row(r) for r in pdf.sort_values("node").itertuples()]
        out = steps[0]
        for step in steps[1:]:
            out = out.then(step, target)
        return _frame([out.row(key[0], key[1])])

    return combine


def _handed_down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    room, part = np.array([pdf["room_in"].iloc[0]]), int(pdf["part_in"].iloc[0])
    rows = []
    for r in pdf.itertuples():
        rows.append((r.file, r.node, int(room[0]), part))
        room, cuts = _Step.from_row(r).apply(room)
        part += int(cuts[0])
    return pd.DataFrame(rows, columns=["file", "node", "room_in", "part_in"])


def _numbered(target: int):
    def number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        room, part = int(pdf["room_in"].iloc[0]), int(pdf["part_in"].iloc[0])
        opens = np.zeros(len(pdf), np.int64)
        opens[_openings(pdf["size"].to_numpy(dtype=np.int64), target, room)] = 1
        return pd.DataFrame({"file": pdf["file"], "line_no": pdf["line_no"], "size": pdf["size"], "part": part + np.cumsum(opens)})

    return number


def greedy_parts(lines: DataFrame, target: int, max_file_blocks: int, block: int = BLOCK,
                 fan_in: int = FAN_IN) -> DataFrame:
    """(file, line_no, size) -> the same with `part` from 1. `line_no` is an integer order
    within the file and `max_file_blocks` an upper bound of line_no / block, which fixes the
    number of levels."""
    rows = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"),
                        F.col("size").cast("bigint").alias("size"))
    rows = rows.withColumn("node", F.floor(F.col("line_no") / block).cast("bigint"))
    # Sizes are few bytes for the work on them: a number of tasks that adaptive coalescing does not lower.
    tasks = TASKS * lines.sparkSession.sparkContext.defaultParallelism
    levels = [rows.repartition(tasks, "file", "node").groupBy("file", "node").applyInPandas(_summaries(target), _NODE)]
    nodes = max_file_blocks
    if nodes > fan_in:  # the summaries are read twice below: cut, so that sizes are read once
        ensure_checkpoint_dir(lines.sparkSession)
        levels[0] = levels[0].checkpoint()
    while nodes > fan_in:
        parent = F.floor(F.col("node") / fan_in).cast("bigint").alias("node")
        levels.append(levels[-1].groupBy("file", parent).applyInPandas(_combined(target), _NODE))
        nodes = -(-nodes // fan_in)
    state = "file string, node bigint, room_in bigint, part_in bigint"
    start = levels[-1].withColumns({"room_in": F.lit(_FULL), "part_in": F.lit(0).cast("bigint")})
    entry = start.groupBy("file", F.lit(0).alias("top")).applyInPandas(_handed_down, state)
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.floor(F.col("node") / fan_in).cast("bigint"))
        given = entry.withColumnRenamed("node", "parent")
        entry = children.join(given, ["file", "parent"]).groupBy("file", "parent").applyInPandas(_handed_down, state)
    out = "file string, line_no bigint, size bigint, part bigint"
    placed = rows.join(entry, ["file", "node"]).repartition(tasks, "file", "node")
    return placed.groupBy("file", "node").applyInPandas(_numbered(target), out)


def even_parts(lines: DataFrame, target: int) -> DataFrame:
    """The cheap form: parts by running bytes, built-in expressions only. Every part but the
    last holds about `target` bytes; use `greedy_parts` where no part may exceed it."""
    summed = running_sum(lines, ["file"], "line_no", F.col("size"), "_running")
    part = F.floor((F.col("_running") - F.col("size")) / target).cast("bigint") + 1
    return summed.withColumn("part", part).drop("_running")


def line_bytes(line: Column) -> Column:
    """Stored size of a line with its line feed."""
    return F.octet_length(line) + 1


def write_parts(numbered: DataFrame, path: str, line: str = "line") -> None:
    """One folder per (file, part); a part never mixes files and keeps its line order."""
    (
        numbered.repartition("file", "part")
        .sortWithinPartitions("file", "part", "line_no")
        .select("file", "part", F.col(line).alias("value"))
        .write.partitionBy("file", "part")
        .mode("overwrite")
        .text(path)
    )

