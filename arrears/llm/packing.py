"""Op 9: packing token sequences into as few fixed-length sequences as possible.

The pieces' lengths are at most the capacity, so a histogram of them has a bounded size
whatever the corpus; it is all that reaches the driver.  There a configuration linear
program (how many sequences of each pattern, a pattern being a multiset of lengths that
fits) is solved approximately by multiplicative weights: each length class has a weight that
falls as the class gets covered, and a knapsack dynamic program prices out the pattern of
the greatest weight.  The fractional solution is rounded down; pieces left over are placed
best fit, largest first, into the slack of the patterns and then into new sequences.

The result is a list of *runs*, each a pattern of exact lengths and a number of copies.
Pieces are numbered within their length by a salted window (a length may belong to a third
of all pieces), and the number of a piece says in which run, copy and place it goes.

Cases: null text counts as empty (the end id alone); longer documents are cut into full
pieces and a rest; repeated rows are packed one by one; ties are interchangeable; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm import common
from arrears.llm.tokens import WordBpe, as_u32, coder, grouped

#: Classes of the linear program, rounds of multiplicative weights, and the share of its
#: demand by which a round covers the scarcest class of its pattern.
CLASSES, ROUNDS, STEP = 256, 1500, 0.25


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    common.small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = coder(WordBpe, tokenizer), as_u32([end_id])
        for b in grouped(batches):
            out = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), c.encode_all(b.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def heaviest_pattern(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how often each class is in the best pattern."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if n:
            gains = best[room - sizes[:n]] + weights[:n]
            k = int(gains.argmax())
            if gains[k] > best[room]:
                best[room], pick[room] = gains[k], k
    times, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            times[pick[room]] += 1
            room -= sizes[pick[room]]
    return times


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                     rounds: int = ROUNDS, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """(pattern, amount): an approximate fractional cover of ``demand`` by patterns."""
    amounts: dict[bytes, float] = {}
    covered = np.zeros(len(sizes))
    for _ in range(rounds):
        done = covered / demand
        weights = sizes * np.exp2(-4 * (done - done.min()))
        times = heaviest_pattern(weights, sizes, capacity)
        used = times > 0
        amount = step * (demand[used] / times[used]).min()
        amounts[times.tobytes()] = amounts.get(times.tobytes(), 0) + amount
        covered += amount * times
        if covered.sum() and (covered / demand).min() >= 4:
            break
    # scale each pattern so that no class is covered more than once over
    over = np.maximum(covered / demand, 1e-9)
    found = [(np.frombuffer(p, np.int64), x) for p, x in amounts.items()]
    return [(p, x / max(1.0, over[p > 0].max())) for p, x in found]


class Runs:
    """Groups of equal sequences under construction, by the room that is left in each."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms = capacity, []
        self.by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def add(self, copies: int, room: int, content: tuple[tuple[int, int], ...]) -> None:
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append((copies, content))

    def take(self, room: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.remove(room)
        return run

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces of one length where they leave the least room."""
        while count:
            k = bisect.bisect_left(self.rooms, length)
            if k < len(self.rooms):
                room = self.rooms[k]
                copies, content = self.take(room)
            else:
                room, copies, content = self.capacity, count, ()
            each = min(room // length, count)  # pieces of this length in each sequence
            used = min(copies, count // each)
            self.add(used, room - each * length, (*content, (length, each)))
            if copies > used and content:
                self.add(copies - used, room, content)
            count -= used * each

    def all(self) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
        return [run for room in self.rooms for run in self.by_room[room]]


def fill(slots: list[int], of_class: dict[int, list[int]], left: dict[int, int], present: list[int],
         capacity: int) -> dict[int, int] | None:
    """Exact lengths for a pattern's slots: the longest left of each slot's class, and for
    the last slot the longest of any class that still fits.  None if a class has run out."""
    chosen: dict[int, int] = {}
    room = capacity
    for k, s in enumerate(slots):
        if k and k == len(slots) - 1:
            at = bisect.bisect_right(present, room) - 1
            n = next((n for n in reversed(present[max(0, at - 8):at + 1]) if left[n] > chosen.get(n, 0)), None)
        else:
            n = next((n for n in of_class[s] if left[n] > chosen.get(n, 0)), None)
        if n is None:
            return None
        chosen[n] = chosen.get(n, 0) + 1
        room -= n
    return chosen


def plan_runs(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(copies, ((length, times), ...)) that together hold every piece exactly once."""
    runs, left = Runs(capacity), dict(zip(lengths.tolist(), counts.tolist()))
    width = max(1, -(-capacity // CLASSES))
    of_class: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        of_class.setdefault(-(-n // width), []).append(n)
    present = sorted(left)
    if len(left) > 1:
        sizes = np.array(sorted(of_class))
        demand = np.array([sum(left[n] for n in of_class[s]) for s in sizes], float)
        for pattern, amount in configuration_lp(sizes, demand, capacity // width):
            slots = np.repeat(sizes, pattern)[::-1].tolist()
            need = int(amount)
            while need and (chosen := fill(slots, of_class, left, present, capacity)):
                copies = min([need, *(left[n] // t for n, t in chosen.items())])
                for n, t in chosen.items():
                    left[n] -= copies * t
                    if not left[n]:
                        present.remove(n)
                runs.add(copies, capacity - sum(n * t for n, t in chosen.items()), tuple(chosen.items()))
                need -= copies
    for n in sorted(left, reverse=True):
        runs.best_fit(n, left[n])
    return runs.all()


def placements(runs: list) -> dict[str, np.ndarray]:
    """For the numbered pieces of each length: from which number on they belong to a run."""
    first, sequence, given, out = 0, 0, {}, []
    for copies, content in runs:
        offset = 0
        for length, times in content:
            first = given.get(length, 0)
            out.append((length, first, sequence, times, offset))
            given[length] = first + copies * times
            offset += length * times
        sequence += copies
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "times", "offset"), table.T.copy()))


def number_within(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` with ``number``, from 0 within each length.

    A length's pieces are dealt over salts of about ``unit`` rows, so no window holds more;
    the salts' row counts, summed in front, make the numbers run on.  ``row`` was fixed when the
    pieces were staged, so rows alike in all else (null or repeated ids) keep their numbers
    when a lost task is run again."""
    unit = min(max(256, total // 2000), 1_000_000)
    sizes = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / unit).cast("long").alias("salts"))  # a row per length
    salted = pieces.join(F.broadcast(sizes), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")) - 1
    return salted.withColumn("inside", inside).join(before.drop("n"), ["length", "salt"]).withColumn(
        "number", F.col("before") + F.col("inside")).drop("before", "inside", "salt")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a staged table with a row number) with sequence_id and offset."""
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # at most ``capacity`` rows
    counts = np.array([r["count"] for r in histogram], np.int64)
    plan = placements(plan_runs(np.array([r["length"] for r in histogram], np.int64), counts, capacity))
    known = plan["length"] << 40 | plan["first"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(known, length << 40 | number, "right") - 1
            copy, slot = np.divmod(number - plan["first"][at], plan["times"][at])
            keep = [c for c in b.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(plan["sequence"][at] + copy),
                 pa.array(plan["offset"][at] + slot * length)], names=[*keep, "sequence_id", "offset"])

    numbered = number_within(pieces, int(counts.sum())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                        "sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    pieces = pieces_of(common.documents(docs), tokenizer, capacity, end_id)
    pieces = common.stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place(pieces, capacity)
