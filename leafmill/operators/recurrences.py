"""Recurrences along an order, computed over ranges in parallel.

Rows are dealt by ranges of (key, order) and sorted, so a key that holds everything is spread over all
partitions. Each range says, in one small row, what it does to the state with which it is entered; these
rows are read in order by one stream that keeps a single state, and each range is then run from its own
entry. Any :class:`Machine` whose effect over a run of rows can be said briefly fits.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from leafmill.functions.text import col
from leafmill.shared import cut


class Machine:
    """States are JSON; ``None`` is that before a key's first row."""

    kind = "double"

    def effect(self, values: list):
        """What a run of rows does to any state, as JSON."""
        raise NotImplementedError

    def after(self, state, effect):
        """The state after a run."""
        raise NotImplementedError

    def run(self, state, values: list) -> tuple[list, object]:
        """What is put out for each row, and the state after them."""
        raise NotImplementedError


@dataclass
class MovingAverage(Machine):
    """``x = (1 - alpha) * x + alpha * value``, begun by the first value; a null changes nothing.

    A row is an affine map, and so is a run of them: two numbers, and what the run gives by itself.
    """

    alpha: float

    def effect(self, values):
        a, b, keep = 1.0, 0.0, 1 - self.alpha
        for v in values:
            if v is not None:
                a, b = a * keep, b * keep + self.alpha * v
        return [a, b, self.run(None, values)[1]]

    def after(self, state, effect):
        a, b, own = effect
        return own if state is None else a * state + b

    def run(self, state, values):
        out = []
        for v in values:
            if v is not None:
                state = v if state is None else state * (1 - self.alpha) + v * self.alpha
            out.append(state)
        return out, state


@dataclass
class Packing(Machine):
    """Greedy packs: a new one begins where the next item would pass ``budget`` and the pack isn't empty.

    The state is (number, load) of the open pack. A run's effect is a step function of the load: where the
    first pack of its own begins depends on it, and all later ones follow from that by pointers from each
    possible beginning to the next. Steps with the same end are one, and there are no more than items in a pack.
    """

    budget: int
    kind = "int"

    def effect(self, values):
        sizes = [v or 0 for v in values]
        upto = [0, *accumulate(sizes)]
        n = len(sizes)
        ends: list = [None] * (n + 1)  # packs and last load if a pack begins at i
        k = n
        for i in range(n - 1, -1, -1):
            # the first item that no longer fits behind i; one that is too large by itself is alone
            while k > i + 1 and upto[k] - upto[i] > self.budget:
                k -= 1
            ends[i] = (1, upto[n] - upto[i]) if k == n else (ends[k][0] + 1, ends[k][1])
        steps: list = []  # loads above ``low`` end so; from the largest load to the least
        low = None
        for j in range(n):
            bound = self.budget - upto[j + 1]
            if low is None or bound < low:
                low = bound
                if steps and steps[-1][1:] == list(ends[j]):
                    steps[-1][0] = bound
                else:
                    steps.append([bound, *ends[j]])
                if bound < 0:
                    break
        return [steps, upto[n], list(ends[0])]

    def after(self, state, effect):
        steps, total, own = effect
        if state is None:
            return [own[0] - 1, own[1]]
        pack, load = state
        at = bisect_right(steps, -load, key=lambda s: -s[0])
        return [pack + steps[at][1], steps[at][2]] if at < len(steps) else [pack, load + total]

    def run(self, state, values):
        out = []
        for v in values:
            v = v or 0
            if state is None:
                state = [0, v]
            elif state[1] + v > self.budget:
                state = [state[0] + 1, v]
            else:
                state = [state[0], state[1] + v]
            out.append(state[0])
        return out, state


def runs_of(batches):
    """A partition's (key, values) runs, from batches of (key, value)."""
    last, held = None, None
    for batch in batches:
        for k, v in zip(batch.column("__key").to_pylist(), batch.column("__value").to_pylist(), strict=True):
            if held is None or k != last:
                if held is not None:
                    yield last, held
                last, held = k, []
            held.append(v)
    if held is not None:
        yield last, held


def recur(rows: DataFrame, key: list[str], order: list[str], value: Column | str, machine: Machine, name: str) -> DataFrame:
    """Add ``name``: what ``machine`` puts out for each row, by key in the order of columns.

    Rows that are equal in key and order are taken in the order of their values. Null keys are a key; an empty table gives none.
    """
    spark = rows.sparkSession
    said = F.to_json(F.struct(*key), {"ignoreNullFields": "false"}) if key else F.lit("")
    keyed = rows.withColumn("__value", col(value)).withColumn("__key", said)
    along = [F.col("__key"), *(F.col(o) for o in order), F.col("__value")]
    # the row's number only spreads rows that are alike in everything else
    dealt = keyed.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *along, F.col("__n"))
    ranged = cut(dealt.drop("__n").sortWithinPartitions(*along))

    def told(batches):
        first = last = None
        for k, values in runs_of(batches):
            if first is None:
                first = {"first": k, "effect": json.dumps(machine.effect(values)), "last": k, "state": None}
            else:
                last = (k, values)
        if last is not None:
            first |= {"last": last[0], "state": json.dumps(machine.run(None, last[1])[1])}
        if first is not None:
            row = {"range": TaskContext.get().partitionId()} | first
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("range", pa.int32()), ("first", pa.string()), ("effect", pa.string()), ("last", pa.string()), ("state", pa.string())]))

    def carried(batches):
        before, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entry = state if r["first"] == before else None
                out.append({"range": r["range"], "entry": json.dumps(entry)})
                before, state = r["last"], machine.after(entry, json.loads(r["effect"])) if r["state"] is None else json.loads(r["state"])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), ("entry", pa.string())]))

    effects = ranged.select("__key", "__value").mapInArrow(told, "range int, first string, effect string, last string, state string")
    # one row for each range, read as a stream
    entries = effects.repartition(1).sortWithinPartitions("range").mapInArrow(carried, "range int, entry string")
    shared = spark.sparkContext.broadcast({r["range"]: r["entry"] for r in entries.collect()})
    kinds = {"int": pa.int32(), "double": pa.float64()}

    def put_out(batches):
        state, last, begun = None, None, False
        for batch in batches:
            out = []
            at = 0
            keys, values = batch.column("__key").to_pylist(), batch.column("__value").to_pylist()
            while at < len(keys):
                stop = at
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if not begun:
                    state, begun = json.loads(shared.value[TaskContext.get().partitionId()]), True
                elif keys[at] != last:
                    state = None
                last = keys[at]
                more, state = machine.run(state, values[at:stop])
                out += more
                at = stop
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rows_columns), pa.array(out, kinds[machine.kind])], [*rows_columns, name])

    rows_columns = rows.columns
    return ranged.mapInArrow(put_out, StructType([*rows.schema.fields, StructField(name, {"int": IntegerType(), "double": DoubleType()}[machine.kind])]))


def moving_average(rows: DataFrame, key: list[str], order: list[str], value: Column | str, alpha: float, name: str = "average") -> DataFrame:
    """The exponential moving average of ``value`` by key, at each row."""
    return recur(rows, key, order, col(value).cast("double"), MovingAverage(alpha), name)
