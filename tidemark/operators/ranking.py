"""Global order without a global window.

``row_number()`` over one unpartitioned window sorts the table in one task.
Here rows are range-partitioned, sorted where they lie, and written with the
block and position they got. A block's rank offset is then the sum of the
earlier block sizes: a table with one row per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

#: monotonically_increasing_id keeps the row offset in its low 33 bits
OFFSET_MASK = (1 << 33) - 1


def place_in_order(df: DataFrame, order: list, label: str = "ordered", unique: bool = False) -> DataFrame:
    """Add ``block`` and ``place`` so that (block, place) follows ``order``.

    Unless keys are ``unique``, a hash of the whole row is the last sort key: rows
    with equal keys may then fall into several blocks, so that a hot key does not
    make one huge block. Rows that are equal throughout are interchangeable, so the
    order needs no number of arrival and the input is not written before the
    shuffle. The result is read back from files: positions cannot change under a
    retry then.
    """
    keys = list(order) if unique else [*order, F.xxhash64(*df.columns)]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = spread.select(
        *df.columns,
        F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(OFFSET_MASK)).alias("place"),
    )
    return materialize(placed, label)


def block_offsets(placed: DataFrame, **totals) -> DataFrame:
    """One row per block with, for each named total, the sum before it.

    The unpartitioned window sees one row per shuffle partition only.
    """
    sums = placed.groupBy("block").agg(*[expr.alias(name) for name, expr in totals.items()])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "block",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0).cast("long")).alias(name) for name in totals],
    )


def dense_row_ids(df: DataFrame, order: list, name: str = "row_id", start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given order."""
    placed = place_in_order(df, order, "rowids")
    offsets = block_offsets(placed, _before=F.count(F.lit(1)))
    joined = placed.join(F.broadcast(offsets), "block")
    return joined.select(*df.columns, (F.col("_before") + F.col("place") + F.lit(start)).alias(name))


#: bins that one counting pass tells apart
BINS = 4096


def counting_key(key: Column, kind: T.DataType) -> Column | None:
    """A long in the order of ``key``, or None for types without one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return key.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(key.cast("timestamp"))
    return None


def nth_value(df: DataFrame, value: Column, n: int) -> tuple[int | None, int, int]:
    """The ``n``-th least value (from 1) of a long column, how many are less, and how many equal.

    None where fewer than ``n`` values are there; all of them count as less then.
    Found by counting: each pass narrows the range ``BINS`` times and brings at
    most as many counts to the driver. Only what ``value`` needs is read.
    """
    values = df.select(value.alias("_v")).filter("_v IS NOT NULL")
    low, high, size = values.agg(F.min("_v"), F.max("_v"), F.count("_v")).first()
    if size < n:
        return None, size, 0
    less, here, own = 0, size, F.col("_v")
    while low < high:
        if high - low >= 1 << 62:  # a difference may not fit; whole multiples of a power of two do
            width, start, bin_ = 1 << 52, 0, F.shiftright(own, 52)
        else:
            width, start = -(-(high - low + 1) // BINS), low
            bin_ = F.call_function("div", own - F.lit(low).cast("long"), F.lit(width).cast("long"))
        counts = values.filter(own.between(low, high)).groupBy(bin_.alias("bin")).count().collect()
        for at, here in sorted(tuple(r) for r in counts):
            if less + here >= n:
                low, high = max(low, start + at * width), min(high, start + (at + 1) * width - 1)
                break
            less += here
    return low, less, here


def first_in_order(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by the given keys, ascending with nulls last; any ``n`` rows without keys.

    The key of the last row is found by counting, one key after the other, so the
    head is a filter on the input: nothing is sorted or written, however long it
    is. Only rows that tie with the last one in all countable keys are ordered by
    the remaining keys, and cut by a limit.
    """
    if not keys or n <= 0:
        return df.limit(max(n, 0))
    kinds = [f.dataType for f in df.select(*keys).schema]
    taken, ties, left = F.lit(False), F.lit(True), n
    for place, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
        value = counting_key(key, kind)
        if value is None:
            break
        last, less, here = nth_value(df.filter(ties), value, left)
        if last is None:
            # all with a value are in, the rest comes from those without
            taken, ties = taken | (ties & value.isNotNull()), ties & value.isNull()
        elif less + here == left:
            taken, less = taken | (ties & (value <= last)), left
        else:
            taken, ties = taken | (ties & (value < last)), ties & (value == last)
        left -= less
        if left == 0:
            break
    else:
        place = len(keys)
    rest = [key.asc_nulls_last() for key in keys[place:]]
    # a filter that is null is not true
    inside = df.filter(F.coalesce(taken, F.lit(False)))
    if left == 0:
        return inside
    tied = df.filter(ties)
    return inside.unionByName((tied.orderBy(*rest) if rest else tied).limit(left))
