"""Results over ordered rows of a key, however many rows a key has.

A range-sorted task reduces the rows of each key to pieces ``(key, seq, cut, ...)``.  A key that lies wholly
inside a task gives one piece with ``cut`` false, which is read where it is.  The pieces of other keys (the first
and the last of a task, and keys beyond a size) are brought together by key and read one after the other, so a
reader holds one batch of pieces at a time, not a key.  ``seq`` ascends in the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LAYOUT = "{key} {kind}, seq long, cut boolean, "


def runs(column: pa.Array) -> list[int]:
    """Row numbers at which a new value starts (null is a value); the column is not empty."""
    at = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return [0, *(i + 1 for i in (at[1:] != at[:-1]).nonzero()[0].tolist())]


def cut_into_runs(batches, key: str, size: int, slices) -> Iterator[tuple[pa.Table, list[int], list[bool]]]:
    """(rows, starts of the keys in them, whether each may go on elsewhere) of a sorted task, about ``size`` bytes
    of ``slices(batch)`` at a time; only a key that exceeds the size is split."""
    pending, held, first = [], 0, True
    for batch in batches:
        for part, n in slices(batch):
            pending.append(part)
            held += n
            if held < size:
                continue
            rows = pa.Table.from_batches(pending).combine_chunks()
            starts = runs(rows.column(key).combine_chunks())
            if len(starts) == 1:
                yield rows, starts, [True]
                pending, held, first = [], 0, True
            else:
                yield rows.slice(0, starts[-1]), starts[:-1], [first] + [False] * (len(starts) - 2)
                pending, held, first = rows.slice(starts[-1]).to_batches(), 0, False
    if pending:
        rows = pa.Table.from_batches(pending).combine_chunks()
        if rows.num_rows:
            starts = runs(rows.column(key).combine_chunks())
            yield rows, starts, [first] + [False] * (len(starts) - 2) + [True] * (len(starts) > 1)


def read_pieces(pieces: DataFrame, reader: Callable, result: str) -> DataFrame:
    """One row (key, ``result`` columns) per key of ``pieces(key, seq, cut, payload...)``.

    ``reader()`` makes an object with ``add(*payload)`` per piece and ``result()``.
    """
    key, seq, cut, *payload = pieces.columns
    names = [c.split()[0] for c in result.split(", ")]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    carried = ", ".join([*kinds, result])

    def whole(batches):
        for batch in batches:
            rows = batch.to_pydict()
            found = [None] * batch.num_rows
            for i, (is_cut, *body) in enumerate(zip(rows[cut], *(rows[c] for c in payload))):
                if not is_cut:
                    one = reader()
                    one.add(*body)
                    found[i] = one.result()
            open_ = pa.array(rows[cut])
            keep = [pc.if_else(open_, batch.column(c), pa.scalar(None, batch.column(c).type)) for c in payload]
            yield _batch([*(batch.column(c) for c in (key, seq, cut)), *keep], [key, seq, cut, *payload], found, names, result)

    def joined(batches):
        now, one, kind = None, None, None
        for batch in batches:
            rows, kind = batch.to_pydict(), batch.schema.field(key).type
            keys, found = [], []
            for value, is_cut, *rest in zip(rows[key], rows[cut], *(rows[c] for c in [*payload, *names])):
                if is_cut and one is not None and now == value:
                    one.add(*rest[:len(payload)])
                    continue
                if one is not None:
                    keys.append(now)
                    found.append(one.result())
                    one = None
                if is_cut:
                    now, one = value, reader()
                    one.add(*rest[:len(payload)])
                else:
                    keys.append(value)
                    found.append(tuple(rest[len(payload):]))
            yield _batch([pa.array(keys, kind)], [key], found, names, result)
        if one is not None:
            yield _batch([pa.array([now], kind)], [key], [one.result()], names, result)

    kept = pieces.mapInArrow(whole, carried).repartition(key).sortWithinPartitions(key, seq)
    return kept.mapInArrow(joined, ", ".join([kinds[0], result]))


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(columns: list, labels: list[str], found: list, names: list[str], result: str) -> pa.RecordBatch:
    types = [_TYPES[c.split()[1]] for c in result.split(", ")]
    more = [pa.array([None if f is None else f[i] for f in found], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*columns, *more], [*labels, *names])
