"""Shards along a Hilbert curve through several metadata columns.

Each column is quantised at its own quantiles, the cells are numbered along a Hilbert curve, rows are sorted by that
number, and the sorted sequence is cut into runs. Rows that are close in every column come to lie in the same shard,
so the minima and maxima of a shard prune files for a filter on any of the columns. Built from DataFrame functions only.

Defined results: a null text has no bytes; a null column value sorts before all others; ties in the curve are ordered
by id, then by the other columns, so repeated rows take neighbouring slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.llm.common import Scratch


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    columns: tuple[str, ...] = ("source", "lang", "n_chars")
    bits: int = 5
    #: Relative rank error of the quantiles is 1 / accuracy.
    accuracy: int = 10_000


def sort_key(df: DataFrame, name: str) -> Column:
    """A number that orders like the column: numbers as they are, texts by their first seven bytes, null first."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = F.col(name).cast("double")
    else:
        number = F.conv(F.hex(F.rpad(F.substring(F.col(name).cast("string").cast("binary"), 1, 7), 7, F.lit(bytearray(1)))), 16, 10).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def hilbert(cells: Column, dims: int, bits: int) -> Column:
    """Place of a cell (array of ``dims`` integers of ``bits`` bits) on the Hilbert curve.

    Walks the bits from the highest down: a set bit of an axis inverts the lower bits of the first axis, a clear one
    swaps them with the first axis; a Gray code then orders the cells, and the bits are read off axis by axis.
    """
    axes = range(dims)

    def turn(x: Column, step: Column) -> Column:
        axis, low = step["axis"], step["low"]
        here, first = F.get(x, axis), F.get(x, F.lit(0))
        on = here.bitwiseAND(low + 1) != 0
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(on, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) | (j == axis), v.bitwiseXOR(swap)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit((1 << b) - 1).cast("long").alias("low")) for b in range(bits - 1, 0, -1) for i in axes])
    turned = F.aggregate(steps, cells.cast("array<bigint>"), turn) if bits > 1 else cells.cast("array<bigint>")
    # Gray code: each axis takes the ones before it, then all take what the last axis' set bits invert.
    gray = F.aggregate(turned, F.array().cast("array<bigint>"), lambda a, v: F.concat(a, F.array(v.bitwiseXOR(F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0).cast("long"))))))
    lows = F.array(*[F.lit((1 << b) - 1).cast("long") for b in range(bits - 1, 0, -1)] or [F.lit(0).cast("long")])
    flip = lambda g: F.aggregate(lows, F.lit(0).cast("long"), lambda t, low: F.when(F.element_at(g, -1).bitwiseAND(low + 1) != 0, t.bitwiseXOR(low)).otherwise(t))
    finished = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(flip(g))))
    places = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(1 << b).cast("long").alias("bit")) for b in range(bits - 1, -1, -1) for i in axes])
    return F.get(F.transform(finished, lambda g: F.aggregate(places, F.lit(0).cast("long"), lambda s, p: s * 2 + F.when(F.get(g, p["axis"]).bitwiseAND(p["bit"]) != 0, 1).otherwise(0))), F.lit(0))


def curve(docs: DataFrame, settings: Settings = Settings()) -> Column:
    """The column's curve place for every row of ``docs``; the quantiles (2**bits - 1 numbers a column) come from all rows."""
    cells = 1 << settings.bits
    ranks = [i / cells for i in range(1, cells)]
    row = docs.agg(*[F.percentile_approx(sort_key(docs, c), ranks, settings.accuracy).alias(f"c{i}") for i, c in enumerate(settings.columns)]).first()
    axes = []
    for i, c in enumerate(settings.columns):
        cuts = F.array(*map(F.lit, sorted(set(row[f"c{i}"] or [0.0]))))
        key = sort_key(docs, c)
        axes.append(F.size(F.filter(cuts, lambda x, key=key: x < key)))
    return hilbert(F.array(*axes), len(axes), settings.bits)


def shards(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, string columns of the contract, and the curve place.

    The law is ``rows``: with n rows, shard s takes the sorted rows from ceil(s n / shards) on. Global places need no
    single sorted partition: a range sort deals the rows out, each partition numbers its own, and one count per
    partition (as many rows as there are partitions) gives the offsets.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = curve(docs, settings)
    slim = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), place.alias("place"))
    scratch = Scratch(docs.sparkSession, "shards")
    order = ["place", "doc_id", "size", "text_crc32"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # The upper bits are the partition, the lower 33 the row's number in it.
    sorted_ = scratch.keep(dealt.withColumn("part", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"), "sorted").df
    counts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                           F.sum("rows").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    k = settings.shards
    position = F.col("before") + F.col("row")
    shard = F.expr(f"((before + row) * {k}) div total")
    return (sorted_.join(F.broadcast(before), "part").withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (position - F.expr(f"(shard * total + {k - 1}) div {k}")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("place").alias("curve")))


def write_shards(docs: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Store ``docs`` (all columns) as files that are runs of the curve: one per shard, sorted, for min/max pruning."""
    place = curve(docs, settings)
    mark = "_curve_place"
    (docs.select(F.struct(*docs.columns).alias("row"), place.alias(mark)).repartitionByRange(settings.shards, mark, "row.doc_id")
     .sortWithinPartitions(mark, "row.doc_id").select("row.*").write.parquet(path))
