"""Per-key results where a few keys hold most rows.

Keys are dictionary-encoded to (block, slot). Each input split, whatever keys it holds, is reduced to dense
accumulator arrays with numpy; arrays of one block are added up in a distributed reduction. No row of a key is moved
to a place that belongs to the key, so a hot key costs no task more than any other. Keys too many for one dictionary
are encoded batch by batch instead, and the batches' arrays are added up by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import written

#: Slots of a block: 4,096 keys times 8 bytes is 32 kB an array.
BLOCK = 4096
#: The dictionary is broadcast up to this many bytes (measured before use); beyond, each batch has a dictionary of its own.
BROADCAST_BYTES = 32 << 20
#: Blocks that a task holds before it hands them on.
HELD_BLOCKS = 256
_LOW = (1 << 31) - 1


def key_dictionary(df: DataFrame, keys: list[str], block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """(keys, block, slot), number of keys, bytes of keys. Rows with a null in any key have no entry."""
    present = df.select(*keys).dropna().distinct()
    table = written(present, "keys")
    size = sum((F.length(F.col(k).cast("string")) for k in keys), F.lit(24))
    count, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-count // block))
    in_block = F.row_number().over(_window(["_block"], keys)) - 1
    out = table.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).withColumn("_slot", in_block.cast("int"))
    return out, count, total


def _window(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def _scatter(kinds: dict[str, str], orders: dict[str, int]):
    """Batches of (_block, _slot, measures) to one row for each touched slot. kinds: measure -> 'sum', 'min', 'max', 'first' or 'last'.

    orders: measure -> how many order columns follow it.
    """
    names = list(kinds)
    ranks = {n: [f"{n}_o{j}" for j in range(orders[n])] for n in names}
    at_column = {n: 2 + sum(1 + orders[m] for m in names[:i]) for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for b, arrays in held.items():
                slots = np.flatnonzero(arrays["_rows"])
                columns = [pa.array(np.full(len(slots), b, np.int32)), pa.array(slots.astype(np.int32)), pa.array(arrays["_rows"][slots])]
                for n in names:
                    if kinds[n] == "sum":
                        columns += [pa.array(arrays[f"{n}_hi"][slots]), pa.array(arrays[f"{n}_lo"][slots])]
                    else:
                        columns += [pa.array(arrays[c][slots], mask=~arrays[f"{n}_seen"][slots]) for c in (n, *ranks[n])]
                yield pa.RecordBatch.from_arrays(columns, names=schema_names)
            held.clear()

        schema_names = ["_block", "_slot", "_rows", *(c for n in names for c in ([f"{n}_hi", f"{n}_lo"] if kinds[n] == "sum" else [n, *ranks[n]]))]
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            slot = batch.column(1).to_numpy(zero_copy_only=False)
            # every block's rows become one contiguous stretch
            order = np.argsort(block, kind="stable") if block[0] != block[-1] or (block != block[0]).any() else None
            measures, by = [], []
            for n in names:
                column = batch.column(at_column[n])
                valid = np.asarray(column.is_valid())
                measures.append((column.fill_null(0).to_numpy(zero_copy_only=False), valid))
                by.append([batch.column(at_column[n] + 1 + j).to_numpy(zero_copy_only=False) for j in range(orders[n])])
            if order is not None:
                block, slot = block[order], slot[order]
                measures = [(v[order], ok[order]) for v, ok in measures]
                by = [[o[order] for o in columns] for columns in by]
            edges = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(block)]):
                b, at = int(block[lo]), slot[lo:hi]
                if b not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from out()
                    held[b] = {"_rows": np.zeros(0, np.int64)}
                arrays = held[b]
                width = int(at.max()) + 1
                if width > len(arrays["_rows"]):
                    _widen(arrays, names, kinds, ranks, max(width, 2 * len(arrays["_rows"])))
                width = len(arrays["_rows"])
                arrays["_rows"] += np.bincount(at, minlength=width)
                for n, (values, valid), ordered in zip(names, measures, by):
                    v, ok = values[lo:hi], valid[lo:hi]
                    v, where = v[ok], at[ok]
                    if kinds[n] == "sum":  # two halves, so that no sum of longs can overflow; the halves are exact in float64
                        low = (v & _LOW).astype(np.float64)
                        high = (v >> 31).astype(np.float64)
                        arrays[f"{n}_lo"] += np.bincount(where, low, minlength=width).astype(np.int64)
                        arrays[f"{n}_hi"] += np.bincount(where, high, minlength=width).astype(np.int64)
                    elif kinds[n] in ("first", "last"):
                        _pick(arrays, n, ranks[n], kinds[n] == "first", where, v, [o[lo:hi][ok] for o in ordered])
                    else:
                        (np.minimum if kinds[n] == "min" else np.maximum).at(arrays[n], where, v)
                        arrays[f"{n}_seen"][where] = True
        yield from out()

    return run


def _scatter_by_batch(keys: int, kinds: dict[str, str], orders: dict[str, int]):
    """Batches of (keys, measures) to one row for each key of a batch: keys that no worker could hold at once are encoded batch by batch."""
    scatter = _scatter(kinds, orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for column in batch.columns[:keys]:
                parts = column.dictionary_encode()
                code = np.unique(code * len(parts.dictionary) + parts.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # never more codes than rows
            _, first, slot = np.unique(code, return_index=True, return_inverse=True)
            coded = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(slot), np.int32)), pa.array(slot.astype(np.int32)), *batch.columns[keys:]], names=["_block", "_slot", *batch.schema.names[keys:]])
            for out in scatter(iter([coded])):
                own = [c.take(pa.array(first[out.column(1).to_numpy()])) for c in batch.columns[:keys]]
                yield pa.RecordBatch.from_arrays([*own, *out.columns[2:]], names=[*batch.schema.names[:keys], *out.schema.names[2:]])

    return run


def _pick(arrays: dict[str, np.ndarray], name: str, ranks: list[str], first: bool, where: np.ndarray, v: np.ndarray, ordered: list[np.ndarray]) -> None:
    """Keep each slot's value of the first (or last) row by the order columns, then by value."""
    if not len(where):
        return
    keys = [*ordered, v]
    row = np.lexsort((*keys[::-1], where))
    edge = where[row][1:] != where[row][:-1]
    row = row[np.concatenate([[True], edge] if first else [edge, [True]])]
    slots = where[row]
    better, equal = np.zeros(len(slots), bool), np.ones(len(slots), bool)
    for column, key in zip((*ranks, name), keys):
        new, old = key[row], arrays[column][slots]
        better |= equal & ((new < old) if first else (new > old))
        equal &= new == old
    better |= ~arrays[f"{name}_seen"][slots]
    row, slots = row[better], slots[better]
    for column, key in zip((*ranks, name), keys):
        arrays[column][slots] = key[row]
    arrays[f"{name}_seen"][slots] = True


def _widen(arrays: dict[str, np.ndarray], names: list[str], kinds: dict[str, str], ranks: dict[str, list[str]], width: int) -> None:
    fresh = {"_rows": (0, np.int64)}
    for n in names:
        if kinds[n] == "sum":
            fresh |= {f"{n}_hi": (0, np.int64), f"{n}_lo": (0, np.int64)}
        else:
            info = np.iinfo(np.int64)
            fresh |= {n: (info.max if kinds[n] == "min" else info.min, np.int64), f"{n}_seen": (False, bool)} | {c: (0, np.int64) for c in ranks[n]}
    for name, (start, kind) in fresh.items():
        old = arrays.get(name, np.zeros(0, kind))
        arrays[name] = np.concatenate([old, np.full(width - len(old), start, kind)])


def dense_aggregate(df: DataFrame, keys: list[str], measures: dict[str, tuple] | None = None, *, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, rows, measures) for every key without a null part.

    measures: name -> (kind, long column), kind being 'sum' (exact, DECIMAL(38,0)), 'min' or 'max' (long), or name ->
    ('first' or 'last', long column, long columns that order rows, null before all). Nulls add nothing; a measure that is
    null in all rows of a key is null, and 0 for sum. No rows give no rows; other columns are ignored, whatever their names.
    """
    measures = measures or {}
    kinds = {n: m[0] for n, m in measures.items()}
    ranks = {n: list(m[2]) if len(m) > 2 else [] for n, m in measures.items()}
    order = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    df = df.select(*keys, *(c for i, (n, m) in enumerate(measures.items()) for c in (F.col(m[1]).cast("long").alias(f"_m{i}"), *(order(o).alias(f"_m{i}_o{j}") for j, o in enumerate(ranks[n])))))
    entries, _, size = key_dictionary(df, keys, block)
    inputs = [c for i, n in enumerate(measures) for c in (F.col(f"_m{i}").alias(n), *(F.col(f"_m{i}_o{j}").alias(f"{n}_o{j}") for j in range(len(ranks[n]))))]
    fields = [("_rows", T.LongType())]
    for n, kind in kinds.items():
        fields += [(f"{n}_hi", T.LongType()), (f"{n}_lo", T.LongType())] if kind == "sum" else [(c, T.LongType()) for c in (n, *(f"{n}_o{j}" for j in range(len(ranks[n]))))]
    counts, made = {n: len(r) for n, r in ranks.items()}, [T.StructField(n, t) for n, t in fields]
    half = T.DecimalType(38, 0)
    totals = [F.sum("_rows").alias("rows")]
    for n, kind in kinds.items():
        if kind == "sum":
            totals.append((F.sum(F.col(f"{n}_hi").cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.sum(F.col(f"{n}_lo").cast("decimal(20,0)"))).cast(half).alias(n))
        elif kind in ("first", "last"):
            seen = F.when(F.col(n).isNotNull(), F.struct(*(f"{n}_o{j}" for j in range(len(ranks[n]))), n))
            totals.append((F.min if kind == "first" else F.max)(seen)[n].alias(n))
        else:
            totals.append((F.min if kind == "min" else F.max)(n).alias(n))
    if size > broadcast_bytes:
        named = {k: f"_k{i}" for i, k in enumerate(keys)}
        rows = df.dropna(subset=keys).select(*[F.col(k).alias(a) for k, a in named.items()], *inputs)
        whole = T.StructType([T.StructField(a, df.schema[k].dataType) for k, a in named.items()] + made)
        summed = rows.mapInArrow(_scatter_by_batch(len(keys), kinds, counts), whole).groupBy(*named.values()).agg(*totals)
        return summed.select(*[F.col(a).alias(k) for k, a in named.items()], "rows", *kinds)
    coded = df.join(F.broadcast(entries), keys).select("_block", "_slot", *inputs)
    parts = coded.mapInArrow(_scatter(kinds, counts), T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_slot", T.IntegerType()), *made]))
    summed = parts.groupBy("_block", "_slot").agg(*totals)
    return summed.join(F.broadcast(entries), ["_block", "_slot"]).select(*keys, "rows", *kinds)


def heavy_keys(df: DataFrame, group: str, key: str, share: float = 0.03) -> DataFrame:
    """(group, key) of non-null keys that hold more than ``share`` of the rows of their group, null keys counted in the total."""
    counted = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.when(F.col(key).isNull(), 1).otherwise(0).alias("_n"))
    # a null key is a key of its own here, so that the same pass also yields the totals
    marked = counted.select("_g", F.coalesce("_k", F.lit("")).alias("_k"), F.col("_n"))
    rows = dense_aggregate(marked, ["_g", "_k", "_n"])
    totals = rows.groupBy("_g").agg(F.sum("rows").alias("_total"))
    found = rows.where("_n = 0").join(totals, "_g")
    parts = 10**6
    return found.where(F.col("rows").cast("decimal(20,0)") * parts > F.col("_total").cast("decimal(20,0)") * round(share * parts)).select(F.col("_g").alias(group), F.col("_k").alias(key))
