"""CB11: clean voltages as an instrument would have taken them, in column expressions.

Every random number is a hash of the seed, the group, the effect's name and its place (channel, anchor, frame): no
stream is drawn in order. So effects don't depend on each other, on partitions or on retries; what was done
can be told without doing it; and no group is ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.functions.arrays import norm, scaled

DRIFT_ANCHORS, COMMON_ANCHORS, MOST_JUMPS, MOST_CHANNELS = 9, 13, 3, 4


@dataclass(frozen=True)
class Instrument:
    """Sizes of the effects; all zero leaves the voltages as they are.

    channel_gain, current_gain: deviation of log gains. offset, drift: in units of a channel's RMS. white, common: in units
    of its deviation over the recording, which is `floor` at least. jump_chance: of a group; jump: in units of the largest deviation.
    """

    channel_gain: float = 0.02
    current_gain: float = 0.01
    offset: float = 1e-3
    drift: float = 1e-3
    white: float = 0.02
    common: float = 0.01
    floor: float = 1e-7
    jump_chance: float = 0.05
    jump: float = 3.0


class Draws:
    """Numbers of one group (column _name) under one seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def _digest(self, effect: str, *place: Column | int) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.col("_name"), F.lit(effect), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in place]))

    @staticmethod
    def _share(digest: Column, at: int) -> Column:
        return F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / float(1 << 52)

    def uniform(self, effect: str, *place: Column | int) -> Column:
        """In [0, 1)."""
        return self._share(self._digest(effect, *place), 1)

    def normal(self, effect: str, *place: Column | int) -> Column:
        """From two uniform numbers of one hash."""
        h = self._digest(effect, *place)
        return F.sqrt(-2 * F.log(self._share(h, 1) + 1.0 / (1 << 52))) * F.cos(2 * F.pi() * self._share(h, 14))


def places(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def anchors(draws: Draws, effect: str, n: int) -> Column:
    """Centred random heights of a curve's anchors, the largest of size one."""
    raw = F.transform(places(n), lambda i: draws.normal(effect, i))
    mean = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(raw, lambda x: x - mean)
    peak = F.greatest(F.array_max(F.transform(centred, F.abs)), F.lit(1e-12))
    return F.transform(centred, lambda x: x / peak)


def height(curve: Column, position: Column, n: int) -> Column:
    """A curve's height at a position from 0 to 1, linear between its anchors."""
    at = position * (n - 1)
    low = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    return F.get(curve, low) + (F.get(curve, low + 1) - F.get(curve, low)) * (at - low)


def recordings(df: DataFrame, vector: str, key: str, order: str, floor: float) -> DataFrame:
    """_key, _name, _first, _last, _channels, and each channel's _rms and _spread, of each group (one row, as long as its channels)."""
    d = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.posexplode_outer(F.col(vector).cast("array<double>")).alias("_c", "_x"))
    by_channel = d.groupBy("_key", "_c").agg(F.min("_order").alias("_first"), F.max("_order").alias("_last"), F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias("_rms"), F.stddev_pop("_x").alias("_sd"))
    one = F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", "_rms", "_sd"))))
    g = by_channel.groupBy("_key").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), one.alias("_of"))
    pick = lambda f: F.transform("_of", f)
    name = F.coalesce(F.concat(F.lit("="), F.col("_key").cast("string")), F.lit("null"))
    return g.select(
        "_key", name.alias("_name"), "_first", "_last", F.size("_of").alias("_channels"), pick(lambda s: F.coalesce(s["_rms"], F.lit(0.0))).alias("_rms"),
        pick(lambda s: F.greatest(F.coalesce(s["_sd"], F.lit(0.0)), F.lit(floor))).alias("_spread"),
    )


def gains(d: DataFrame, draws: Draws, k: Instrument) -> DataFrame:
    current = F.exp(k.current_gain * draws.normal("current"))
    return d.withColumn("current_gain", current).withColumn("channel_gain", F.transform(places(F.col("_channels")), lambda c: F.exp(k.channel_gain * draws.normal("gain", c))))


def offsets(d: DataFrame, draws: Draws, k: Instrument) -> DataFrame:
    return d.withColumn("static_offset", F.transform("_rms", lambda r, c: k.offset * r * draws.normal("offset", c)))


def contact_drift(d: DataFrame, draws: Draws, k: Instrument) -> DataFrame:
    d = d.withColumn("drift_spatial", F.transform(places(F.col("_channels")), lambda c: draws.normal("contact", c)))
    return d.withColumn("_drift_curve", anchors(draws, "drift", DRIFT_ANCHORS)).withColumn("_drift", F.zip_with("_rms", "drift_spatial", lambda r, s: k.drift * r * s))


def common_noise(d: DataFrame, draws: Draws, k: Instrument) -> DataFrame:
    d = d.withColumn("_raw", F.transform(places(F.col("_channels")), lambda c: draws.normal("common", c)))
    d = d.withColumn("correlated_spatial", scaled("_raw", 1 / F.greatest(norm("_raw"), F.lit(1e-12))))
    return d.withColumn("_common_curve", anchors(draws, "curve", COMMON_ANCHORS)).withColumn("_common", scaled("correlated_spatial", k.common * norm("_spread"))).drop("_raw")


def jumps(d: DataFrame, draws: Draws, k: Instrument) -> DataFrame:
    """Events (frame, channels, increments): by chance one to three, in one to four channels of one frame each."""
    n = F.when(draws.uniform("jumps") < k.jump_chance, 1 + F.floor(MOST_JUMPS * draws.uniform("how many"))).otherwise(0)
    largest = F.greatest(F.coalesce(F.array_max("_spread"), F.lit(0.0)), F.lit(1e-12))

    def event(e: Column) -> Column:
        shuffled = F.array_sort(F.transform(places(F.col("_channels")), lambda c: F.struct(draws.uniform("pick", e, c).alias("u"), c.alias("c"))))
        some = F.transform(F.slice(shuffled, 1, (1 + F.floor(MOST_CHANNELS * draws.uniform("channels", e))).cast("int")), lambda s: s["c"].cast("long"))
        frame = F.col("_first") + F.floor((F.col("_last") - F.col("_first") + 1) * draws.uniform("frame", e))
        return F.struct(frame.cast("long").alias("frame"), some.alias("channels"), F.transform(some, lambda c: k.jump * largest * draws.normal("jump", e, c)).alias("increments"))

    return d.withColumn("artifact_events", F.transform(places(n), event))


def augment(df: DataFrame, vector: str, *, key: str, order: str, seed: int, instrument: Instrument = Instrument()) -> tuple[DataFrame, DataFrame]:
    """CB11: the frames (key, order, augmented) of each group with acquisition effects, and one row of what was done for each group.

    A voltage is multiplied by its channel's and the current's gain; then an offset, a drift over the recording, white noise,
    noise that channels share, and jumps are added. Curves follow `order`, a whole number, from the group's first to its
    last (consecutive numbers are its index). Null vectors and components stay null and don't count in a channel's
    size; frames may be of different lengths; a null key is a group; frames without order have the first one's drift and no
    jump. Repeated rows get equal noise. Empty table: no rows.
    """
    draws, k = Draws(seed), instrument
    done = recordings(df, vector, key, order, k.floor)
    for effect in (gains, offsets, contact_drift, common_noise, jumps):
        done = effect(done, draws, k)
    f = df.select(F.col(key).alias(key), F.col(order).alias(order), F.col(vector).cast("array<double>").alias("_v"))
    d = f.join(done, f[key].eqNullSafe(done["_key"]))
    position = F.coalesce(F.try_divide((F.col(order) - F.col("_first")).cast("double"), (F.col("_last") - F.col("_first")).cast("double")), F.lit(0.0))
    d = d.withColumn("_at_drift", height(F.col("_drift_curve"), position, DRIFT_ANCHORS)).withColumn("_at_common", height(F.col("_common_curve"), position, COMMON_ANCHORS))
    d = d.withColumn("_now", F.filter("artifact_events", lambda e: e["frame"] == F.col(order)))

    def jumped(c: Column) -> Column:
        in_event = lambda e: F.coalesce(F.try_element_at(e["increments"], F.array_position(e["channels"], c.cast("long")).cast("int")), F.lit(0.0))
        return F.aggregate("_now", F.lit(0.0), lambda s, e: s + F.when(F.array_contains(e["channels"], c.cast("long")), in_event(e)).otherwise(0.0))

    def taken(x: Column, c: Column) -> Column:
        at = lambda name: F.get(name, c)
        steady = F.col("current_gain") * at("channel_gain") * x + at("static_offset") + F.col("_at_drift") * at("_drift") + F.col("_at_common") * at("_common")
        white = (k.white * at("_spread") + k.floor) * draws.normal("white", F.coalesce(F.col(order).cast("string"), F.lit("")), c)
        return steady + white + F.when(F.size("_now") > 0, jumped(c)).otherwise(0.0)

    frames = d.select(key, order, F.transform("_v", taken).alias("augmented"))
    return frames, done.select(F.col("_key").alias(key), "current_gain", "channel_gain", "static_offset", "drift_spatial", "correlated_spatial", "artifact_events")
