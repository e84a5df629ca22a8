"""Training batches in a new random order each epoch, without a sort or a shuffle.

A window's place in an epoch is a keyed bijection of its ordinal, so its batch is an expression of the window alone. The
ordinals 0 to n - 1 are written as pairs over two radices whose product is n or slightly more; rounds add a digest of one half
to the other, which can be undone whatever the digest is. A result of n or more is mapped again until it is less. There are
``excess`` such values and none comes twice, so ``excess`` further turns are always enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import sequences
from panelcast.operators.outline import one_per_series
from panelcast.spec import PanelSpec

FEISTEL_ROUNDS = 6
#: Hexadecimal digits of the digest that are used.
DIGITS = 12


@dataclass(frozen=True)
class Radices:
    """Two radices whose product exceeds ``n`` by as little as any in their range does."""

    n: int
    low: int
    high: int

    @property
    def excess(self) -> int:
        return self.low * self.high - self.n


def radices(n: int) -> Radices:
    """The least excess, and the most even pair of these; ``low`` is from a quarter of the root of n to the root."""
    root = math.isqrt(max(n, 4))
    found = ((-n % low, -low) for low in range(max(2, root // 4), root + 1))
    low = -min(found)[1]
    return Radices(n, low, -(-n // low))


def keyed(seed: int, epoch: Column, round_: Column, half: Column) -> Column:
    """A number from the digest of seed, epoch, round and half."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def shuffled(ordinal: Column, epoch: Column, r: Radices, seed: int) -> Column:
    """The place of an ordinal in an epoch: each ordinal below ``r.n`` has another place below ``r.n``."""

    def turn(x: Column) -> Column:
        start = F.struct((x % r.low).alias("l"), F.floor(x / r.low).cast("bigint").alias("h"))

        def one(s: Column, k: Column) -> Column:
            low = F.when(k % 2 == 0, (s["l"] + keyed(seed, epoch, k, s["h"])) % r.low).otherwise(s["l"])
            high = F.when(k % 2 == 1, (s["h"] + keyed(seed, epoch, k, s["l"])) % r.high).otherwise(s["h"])
            return F.struct(low.alias("l"), high.alias("h"))

        rounds = F.array(*[F.lit(k) for k in range(FEISTEL_ROUNDS)])
        return F.aggregate(rounds, start, one, lambda s: s["l"] + s["h"] * r.low)

    again = F.sequence(F.lit(1), F.lit(r.excess)) if r.excess else None
    first = turn(ordinal)
    return first if again is None else F.aggregate(again, first, lambda y, _: F.when(y >= r.n, turn(y)).otherwise(y))


def train_batches(outline: DataFrame, spec: PanelSpec, epochs: int, first: int = 0) -> DataFrame:
    """``epoch``, ``batch_id`` and ``slot`` of every training window, without the last batch of an epoch if it is short.

    ``outline`` is the labelled outline with ``windows_before`` (see ``sequences.number_windows``). Batches of an epoch
    are numbered from 0; a batch's windows are those with its number, in any order of rows.
    """
    train = outline.filter(F.col("split") == "train")
    length = F.col("valid_length")
    own = F.greatest(F.lit(0), F.floor((length - spec.lookback) / spec.train_stride) + 1)
    n = one_per_series(train).agg(F.sum(own)).first()[0] or 0
    starts = sequences.window_starts(train, spec, ("windows_before",))
    ordinal = (F.col("windows_before") + F.floor(F.col("start") / spec.train_stride)).cast("bigint")
    each = starts.withColumn("epoch", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + epochs - 1).cast("bigint"))))
    place = shuffled(ordinal, F.col("epoch"), radices(n), spec.seed)
    placed = each.withColumn("_place", place)
    batch = F.floor(F.col("_place") / spec.batch_size).cast("bigint")
    whole = n // spec.batch_size
    return placed.select(
        *spec.pair, "start", "epoch", batch.alias("batch_id"), (F.col("_place") % spec.batch_size).cast("bigint").alias("slot"),
    ).filter(F.col("batch_id") < whole)
