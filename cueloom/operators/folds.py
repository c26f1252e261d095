"""Folds over the rows of each key in order, as a stream: a key of any size needs the memory of one state.

``fold_in_order`` folds a key in one task. ``fold_in_pieces`` deals rows out by ranges of key and order, so that a key of
any size is spread over tasks, for states that can be begun anew at some rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class State(Protocol):
    def take(self, row: dict) -> Iterable[tuple]:
        """Rows that are settled once this row is seen."""

    def end(self) -> Iterable[tuple]:
        """Rows that are settled once no row is left."""


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, by column: numbers without nulls are taken as arrays."""
    columns = [c.to_numpy().tolist() if c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)) else c.to_pylist() for c in batch.columns]
    names = batch.schema.names
    return (dict(zip(names, values)) for values in zip(*columns))


def fold_in_order(rows: DataFrame, key: str, order: str, start: Callable[[object], State], schema: str) -> DataFrame:
    """Rows of ``schema`` from one state a key, which ``start(key)`` makes and which takes the key's rows by ``order``."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in _rows(batch):
                if state is None or row[key] != now:
                    out += state.end() if state is not None else ()
                    now, state = row[key], start(row[key])
                out += state.take(row)
            if out:
                yield batch_of(out)
        if state is not None and (out := list(state.end())):
            yield batch_of(out)

    placed = rows.repartition(key).sortWithinPartitions(key, order)
    if isinstance(rows.schema[order].dataType, StructType):  # states take what it stands for from other columns
        placed = placed.drop(order)
    return placed.mapInArrow(mapped, schema)


class PieceState(State, Protocol):
    def cuts(self, row: dict) -> bool:
        """Whether this row settles all before it, whatever that was: a new state that takes it goes on as this one would.

        It is asked of each row in order, before the row is taken; what it remembers may begin at any row.
        """

    def end_before(self, row: dict) -> Iterable[tuple]:
        """Rows that are settled once a row that cuts is seen; the state is not used after that."""


#: Rows of a piece that a task remembers; a longer piece is left to the second pass, which streams it.
REMEMBERED = 50_000
_HEAD, _CUT, _SETTLED, _TAIL = range(4)


def fold_in_pieces(rows: DataFrame, key: str, order: list[str], start: Callable[[object], PieceState], schema: str) -> DataFrame:
    """(key, n, columns of schema): as ``fold_in_order``, n counting a key's rows from 0, for states that know where they may be cut.

    Rows are dealt out by ranges of (key, order). A task folds the pieces between the cuts that it sees; what stands before
    its first cut and after its last one may belong to its neighbours, and goes on as raw rows. A second pass by key joins
    these at the seams and counts; its rows are the settled ones and two pieces a task, so that a large key is no burden.
    Between two cuts a piece is folded by one task.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    source = rows.select(key, *order, *[c for c in rows.columns if c != key and c not in order])
    names = [f.name for f in kinds]
    types = dict(source.dtypes)
    middle = ", ".join(f"`{c}` {types[c]}" for c in (key, *order)) + f", kind int, seq long, row struct<{', '.join(f'`{c}`:{t}' for c, t in source.dtypes)}>, out struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in StructType.fromDDL(schema))}>"
    between = to_arrow_schema(StructType.fromDDL(middle))
    final = f"`{key}` {types[key]}, n long, {schema}"
    last = to_arrow_schema(StructType.fromDDL(final))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        seq = 0

        def put(row: dict, kind: int, settled: tuple | None = None) -> None:
            nonlocal seq
            out.append({key: row[key], **{c: row[c] for c in order}, "kind": kind, "seq": seq, "row": None if kind == _SETTLED else row, "out": dict(zip(names, settled)) if settled is not None else None})
            seq += 1

        state = first = None  # first: the row that the open piece began with; before the first cut there is none
        piece: list[dict] | None = []  # the rows of the open piece, or nothing where they went out as raw rows already
        held: list[tuple] = []
        head = True
        seen = False
        now = None
        for batch in batches:
            for row in _rows(batch):
                fresh = seen and row[key] != now
                if state is None or fresh:
                    if fresh and not head and piece is not None:  # the key before has ended here
                        for settled in (*held, *state.end()):
                            put(first, _SETTLED, settled)
                    head = not fresh  # only the first key of a task may have begun before
                    state, first, piece, held = start(row[key]), row, [], []
                    now, seen = row[key], True
                    state.cuts(row)
                elif state.cuts(row):
                    if head or piece is None:
                        put(row, _CUT)
                    else:
                        for settled in (*held, *state.end_before(row)):
                            put(first, _SETTLED, settled)
                    head, state, first, piece, held = False, start(row[key]), row, [], []
                    state.cuts(row)
                if head:
                    put(row, _HEAD)
                elif piece is None:
                    put(row, _TAIL)
                else:
                    piece.append(row)
                    held += state.take(row)
                    if len(piece) > REMEMBERED:
                        for r in piece:
                            put(r, _TAIL)
                        piece, held = None, []
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, between)
                    out = []
        for row in piece or () if not head else ():
            put(row, _TAIL)
        if out:
            yield pa.RecordBatch.from_pylist(out, between)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, count, seen = None, None, 0, False
        for batch in batches:
            out: list[tuple] = []

            def put(some: Iterable[tuple]) -> None:
                nonlocal count
                for settled in some:
                    out.append((now, count, *settled))  # noqa: B023
                    count += 1

            for row in _rows(batch):
                if not seen or row[key] != now:
                    if state is not None:
                        put(state.end())
                    now, state, count, seen = row[key], None, 0, True
                if row["kind"] == _CUT:
                    if state is not None:
                        put(state.end_before(row["row"]))
                    state = None
                elif row["kind"] == _SETTLED:
                    if state is not None:
                        put(state.end())
                    state = None
                    put([tuple(row["out"][c] for c in names)])
                else:
                    if state is None:
                        state = start(now)
                    put(state.take(row["row"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), last)], schema=last)
        if state is not None:
            out = []
            for settled in state.end():
                out.append((now, count, *settled))
                count += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), last)], schema=last)

    sorted_rows = source.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    mixed = sorted_rows.mapInArrow(pieces, middle).repartition(key).sortWithinPartitions(key, *order, "seq")
    return mixed.mapInArrow(joined, final)
