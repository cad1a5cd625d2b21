"""Online analysis of bursts, as Structured Streaming and as batch."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.graph import components
from tracewright.operators.trace import long_bursts, running_total
from tracewright.session import checkpointed


def sum_signals(bursts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, value): the sum of step signals (ts, dur, value): each adds its value at ts and takes it away at ts + dur."""
    keys = list(keys)
    steps = bursts.select(*keys, F.explode(F.array(F.struct(F.col("ts").alias("time"), F.col("value").alias("d")), F.struct((F.col("ts") + F.col("dur")).alias("time"), (-F.col("value")).alias("d")))).alias("s")).select(*keys, "s.*")
    summed = steps.groupBy(*keys, "time").agg(F.sum("d").alias("d"))
    return running_total(summed, ["time"], "d", "value", keys).drop("d")


def compress(signal: DataFrame, keys: Sequence[str], most: int = 10_000) -> DataFrame:
    """At most `most` points of each key: means over equal runs of points. Places are counted over ranges of the key, so that one key is many tasks."""
    keys = list(keys)
    placed = running_total(signal.withColumn("_one", F.lit(1).cast("long")), ["time"], "_one", "_place", keys)
    sizes = signal.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = placed.join(sizes, keys) if keys else placed.crossJoin(F.broadcast(sizes))  # one row
    run = F.expr(f"(_place - 1) div ceil(_n / {most})")
    return sized.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("time").alias("time"), F.avg("value").alias("value")).drop("_run")


def dominant_period(values: np.ndarray) -> tuple[int, float]:
    """The lag of the first strong peak of the autocorrelation, and its height."""
    x = np.asarray(values, float) - np.mean(values)
    n = len(x)
    if n < 4 or not x.any():
        return 0, 0.0
    f = np.fft.rfft(x, 2 * n)
    r = np.fft.irfft(f * np.conj(f))[: n // 2 + 1] / np.arange(n, n - n // 2 - 1, -1)
    return peak_of(r)


def dominant_periods(signals: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """dominant_period of each row of a matrix, some `most` values at a time."""
    m, n = signals.shape
    best, height = np.zeros(m, np.int64), np.zeros(m)
    if n < 6:  # no lag has one on either side
        return best, height
    step = max(1, most // n)
    for i in range(0, m, step):
        x = signals[i : i + step] - signals[i : i + step].mean(axis=1, keepdims=True)
        f = np.fft.rfft(x, 2 * n, axis=1)
        r = np.fft.irfft(f * np.conj(f), axis=1)[:, : n // 2 + 1] / np.arange(n, n - n // 2 - 1, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = r / r[:, :1]
        own = r[:, 2:-1]
        peaks = (own >= r[:, 1:-2]) & (own > r[:, 3:]) & x.any(axis=1, keepdims=True) & np.isfinite(r[:, :1])
        top = np.where(peaks, own, -np.inf).max(axis=1, initial=-np.inf)
        strong = peaks & (own >= 0.9 * top[:, None])
        some = strong.any(axis=1)
        at = strong.argmax(axis=1)[some]
        best[i : i + step][some] = at + 2
        height[i : i + step][some] = own[some, at]
    return best, height


def periods(signal: DataFrame, key: str) -> DataFrame:
    """T4: (key, period, goodness, iterations) of compressed, evenly sampled signals (at most 10,000 points of a key). The spectral
    library used elsewhere isn't public; this is an autocorrelation of its own.

    A signal is one row, and signals of one length are transformed together: a call for each would take longer than its transform."""
    kind = signal.schema[key].dataType.simpleString()
    points = F.array_sort(F.collect_list(F.struct(F.col("time").isNull().alias("none"), "time", F.col("value").cast("double").alias("value"))))
    rows = signal.groupBy(key).agg(points.alias("x")).select(key, F.transform("x", lambda p: p["value"]).alias("x"))
    signal.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            sizes = np.diff(ends)
            found, good = np.zeros(len(b), np.int64), np.zeros(len(b))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                found[at], good[at] = dominant_periods(values[ends[at][:, None] + np.arange(n)].astype(float))
            times = np.where(found > 0, sizes // np.maximum(found, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), pa.array(good), pa.array(times.astype(np.int64))], [key, "period", "goodness", "iterations"])

    return rows.mapInArrow(run, f"{key} {kind}, period long, goodness double, iterations long")


def peak_of(r: np.ndarray) -> tuple[int, float]:
    """The lag of the first strong peak of an autocorrelation (by lag, from 0), and its height against lag 0."""
    if len(r) < 3 or r[0] == 0:
        return 0, 0.0
    r = r / r[0]
    peaks = [k for k in range(2, len(r) - 1) if r[k] >= r[k - 1] and r[k] > r[k + 1]]
    if not peaks:
        return 0, 0.0
    top = max(r[k] for k in peaks)
    best = next(k for k in peaks if r[k] >= 0.9 * top)
    return best, float(r[best])


def long_periods(signal: DataFrame, key: str, most_lag: int = 5_000, block: int | None = None) -> DataFrame:
    """T4: (key, period, goodness, iterations) of evenly sampled signals of any length, with periods up to most_lag points; no key's signal is gathered.

    Points get their place in the key over ranges; blocks of points, with the most_lag points that follow each, are correlated by FFT and added up by lag,
    so a task holds one block; a key's most_lag sums are all that meets in one task in the end."""
    kind = signal.schema[key].dataType.simpleString()
    size = block or max(4 * most_lag, 65_536)
    placed = running_total(signal.select(key, "time", "value").withColumn("_one", F.lit(1).cast("long")), ["time"], "_one", "_place", [key])
    stats = signal.groupBy(key).agg(F.avg("value").alias("_mean"), F.count("*").alias("_n"))
    rows = placed.join(stats, key).select(key, (F.col("_place") - 1).alias("i"), (F.col("value") - F.col("_mean")).alias("x"), "_n")
    own = F.expr(f"i div {size}")
    # what follows a block is also in its group, as its tail
    both = rows.select(key, own.alias("block"), "i", "x", "_n").union(rows.where(f"i >= {size} and i % {size} < {most_lag}").select(key, own - 1, "i", "x", "_n"))

    def correlated(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        start, b = int(k[1]) * size, b.sort_values("i")
        x, n = b["x"].to_numpy(float), int(b["_n"].iloc[0])
        head = x[: int(np.searchsorted(b["i"].to_numpy(), start + size))]
        lags = min(most_lag, n // 2) + 1
        width = 1 << int(len(x) + len(head)).bit_length()
        r = np.fft.irfft(np.conj(np.fft.rfft(head, width)) * np.fft.rfft(x, width), width)[:lags]
        r = np.pad(r, (0, max(0, lags - len(r))))
        r[np.arange(lags) >= len(x)] = 0.0
        return pd.DataFrame({key: [k[0]] * lags, "lag": np.arange(lags), "r": r, "n": n})

    sums = both.groupBy(key, "block").applyInPandas(correlated, f"{key} {kind}, lag long, r double, n long").groupBy(key, "lag").agg(F.sum("r").alias("r"), F.first("n").alias("n"))

    def found(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b, n = b.sort_values("lag"), int(b["n"].iloc[0])
        p, good = peak_of(b["r"].to_numpy() / np.arange(n, n - len(b), -1)) if n >= 4 else (0, 0.0)
        return pd.DataFrame([(k[0], p, good, n // p if p else 0)], columns=[key, "period", "goodness", "iterations"])

    return sums.groupBy(key).applyInPandas(found, f"{key} {kind}, period long, goodness double, iterations long")


def likeness(a: Sequence[float], b: Sequence[float]) -> float:
    """100 for equal vectors, less by their distance relative to the longer one."""
    d = math.dist(a, b)
    m = max(math.hypot(*a), math.hypot(*b))
    return 100.0 if m == 0 else max(0.0, 100.0 * (1 - d / m))


class Representatives:
    """The first stored representative that is like enough counts the new one, else that is stored. A representative is traced once,
    when it has been seen more than min_seen times, while fewer than max_traced (0: any number) are."""

    def __init__(self, min_likeness: float = 85, min_seen: int = 0, max_traced: int = 0):
        self.min_likeness, self.min_seen, self.max_traced = min_likeness, min_seen, max_traced
        self.stored: list[list] = []  # vector, seen, traced
        self.traced = 0

    def see(self, vector: Sequence[float]) -> tuple[int, int, bool]:
        """(representative, times seen, traced now)."""
        at = next((i for i, (v, _, _) in enumerate(self.stored) if likeness(v, vector) >= self.min_likeness), None)
        if at is None:
            at = len(self.stored)
            self.stored.append([list(vector), 0, False])
        own = self.stored[at]
        own[1] += 1
        now = not own[2] and own[1] > self.min_seen and (self.max_traced == 0 or self.traced < self.max_traced)
        if now:
            own[2] = True
            self.traced += 1
        return at, own[1], now


REPRESENTED = "phase long, representative long, seen long, traced boolean"


def representatives(phases: DataFrame, min_likeness: float = 85, min_seen: int = 0, max_traced: int = 0, app: str | None = None) -> DataFrame:
    """T5, T6 on a stream or a batch of phases (phase long, vector array<double>): one row for each phase. The list of representatives of
    an application is one by definition, so it is the state of the key `app` (one for all rows without it); there is a row for each
    period of an application, not for each event."""
    keyed = phases.select((F.lit(0) if app is None else F.col(app)).alias("all"), "phase", "vector")
    shape = REPRESENTED if app is None else f"{app} {phases.schema[app].dataType.simpleString()}, {REPRESENTED}"

    def step(rep: Representatives, rows: pd.DataFrame, key: tuple = (0,)) -> pd.DataFrame:
        found = pd.DataFrame([(int(p), *rep.see(list(v))) for p, v in rows.sort_values("phase")[["phase", "vector"]].itertuples(index=False)], columns=["phase", "representative", "seen", "traced"])
        if app is not None:
            found.insert(0, app, key[0])
        return found

    if not phases.isStreaming:
        return keyed.groupBy("all").applyInPandas(lambda key, rows: step(Representatives(min_likeness, min_seen, max_traced), rows, key), shape)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rep = Representatives(min_likeness, min_seen, max_traced)
        if state.exists:
            vectors, seen, traced = state.get
            rep.stored = [[list(v), s, t] for v, s, t in zip(vectors, seen, traced, strict=True)]
            rep.traced = sum(traced)
        yield step(rep, pd.concat(list(batches)), key)
        state.update(([list(map(float, v)) for v, _, _ in rep.stored], [s for _, s, _ in rep.stored], [t for _, _, t in rep.stored]))

    return keyed.groupBy("all").applyInPandasWithState(update, shape, "vectors array<array<double>>, seen array<long>, traced array<boolean>", "append", "NoTimeout")


def representatives_in_rounds(phases: DataFrame, min_likeness: float = 85, min_seen: int = 0, max_traced: int = 0, app: str | None = None) -> DataFrame:
    """representatives()'s rows of a batch, the same first-come result, for an application of any number of phases.

    Two vectors are alike enough if they are no further apart than a share of the longer one, so phases are put into cells of a size in
    proportion to their length (shells of lengths in a ratio of that share; in each, a coarse grid of the first three coordinates to look in, and
    a fine one whose members are all alike). In a round the first undecided phase of each fine cell asks whether an earlier undecided one is like it:
    if not, it is a representative, and later phases that are like it are decided. Every round decides the first undecided phase of all,
    and in most data as many as there are places; a phase meets one of each fine cell near it, never all phases of its cell."""
    share = 1 - min_likeness / 100
    if not 0 < share < 1:
        raise ValueError("min_likeness must be between 0 and 100")
    ratio = 1 / (1 - share)
    key = F.lit(0) if app is None else F.col(app)
    rows = phases.select(key.alias("app"), F.col("phase").cast("long").alias("phase"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    shell = F.when(norm == 0, F.lit(None).cast("int")).otherwise(F.floor(F.log(norm) / math.log(ratio)).cast("int"))
    rows = rows.select("*", norm.alias("norm"), shell.alias("shell"))
    side = F.lit(share) * F.pow(F.lit(ratio), F.coalesce("shell", F.lit(0)))  # phases of the shell within it are alike
    fine = F.xxhash64("app", "shell", F.transform("vector", lambda x: F.floor(x / (side / F.sqrt(F.size("vector").cast("double"))) * 1.0000001)))
    rows = checkpointed(rows.withColumn("fine", fine))

    def cells(of: DataFrame, near: bool) -> DataFrame:
        """The rows with the coarse cells that they are in (near: and all cells around), of their own shell's grid and of the next longer one's."""
        own = of.withColumn("grid", F.explode(F.when(F.col("shell").isNull(), F.array(F.lit(-(2**31)))).otherwise(F.array(F.col("shell"), F.col("shell") + 1))))
        size = F.when(F.col("shell").isNull(), F.lit(1.0)).otherwise(F.lit(share * ratio * 1.000001) * F.pow(F.lit(ratio), F.col("grid")))
        at = [F.coalesce(F.floor(F.get("vector", F.lit(i)) / size), F.lit(0)).cast("long") for i in range(3)]
        own = own.select("*", *[a.alias(f"c{i}") for i, a in enumerate(at)])
        if near:
            step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
            for i in range(3):
                own = own.withColumn("d", F.explode(step)).withColumn(f"c{i}", F.col(f"c{i}") + F.col("d")).drop("d")
        return own.select("*", F.xxhash64("app", "grid", "c0", "c1", "c2").alias("cell")).drop("grid", "c0", "c1", "c2")

    def met(left: DataFrame, ones: DataFrame, order: str) -> DataFrame:
        """(app, phase, one): which of `ones`, one for each fine cell at most, each row is like; order: how their phases must lie."""
        there = cells(ones, True).select("cell", F.col("app").alias("_app"), F.col("phase").alias("one"), F.col("vector").alias("_v"), F.col("norm").alias("_n"))
        d = F.sqrt(F.aggregate(F.zip_with("vector", "_v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        m = F.greatest("norm", "_n")
        alike = F.when(m == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100.0 * (1 - d / m))) >= min_likeness
        return cells(left, False).join(there, "cell").where((F.col("app").eqNullSafe(F.col("_app"))) & F.expr(f"phase {order} one") & (F.size("vector") == F.size("_v")) & alike).select("app", "phase", "one")

    open_, leaders = rows, None
    while not open_.isEmpty():
        firsts = checkpointed(open_.groupBy("fine").agg(F.min_by(F.struct(*rows.columns), "phase").alias("x")).select("x.*"))
        waiting = met(open_, firsts, "<").select("app", F.col("one").alias("phase")).distinct()
        new = checkpointed(firsts.join(waiting, (firsts["phase"] == waiting["phase"]) & firsts["app"].eqNullSafe(waiting["app"]), "left_anti"))
        leaders = new if leaders is None else checkpointed(leaders.union(new), None, [leaders])
        done = met(open_, new, ">=").select(F.col("app").alias("_app"), F.col("phase").alias("_phase")).distinct()
        open_ = checkpointed(open_.join(done, (F.col("phase") == F.col("_phase")) & F.col("app").eqNullSafe(F.col("_app")), "left_anti"), None, [open_] if open_ is not rows else [])
    shape = phases.select(key.alias(app or "all")).schema[0]
    if leaders is None:
        return phases.sparkSession.createDataFrame([], ("" if app is None else f"{app} {shape.dataType.simpleString()}, ") + REPRESENTED)
    own = met(rows, leaders, ">=").groupBy("app", "phase").agg(F.min("one").alias("one"))
    numbers = leaders.select(F.col("app").alias("_app"), F.col("phase").alias("_one"), (F.row_number().over(Window.partitionBy("app").orderBy("phase")) - 1).cast("long").alias("representative"))
    own = own.join(numbers, (F.col("one") == F.col("_one")) & F.col("app").eqNullSafe(F.col("_app"))).select("app", "phase", "representative", F.lit(1).cast("long").alias("_1"), F.xxhash64("app").alias("_a"))
    seen = checkpointed(running_total(own, ["phase"], "_1", "seen", ["_a", "representative"]))
    # a representative is traced the first time that it has been seen often enough, the first max_traced of these times
    times = seen.where(F.col("seen") == min_seen + 1).select(F.col("_a").alias("_b"), F.col("phase").alias("_at"), F.row_number().over(Window.partitionBy("_a").orderBy("phase")).alias("_k"))
    times = times.where(F.col("_k") <= max_traced) if max_traced else times
    both = seen.join(times, (F.col("phase") == F.col("_at")) & (F.col("_a") == F.col("_b")), "left")
    return both.select(*([] if app is None else [F.col("app").alias(app)]), "phase", "representative", "seen", F.col("_at").isNotNull().alias("traced"))


def stream_energy(samples: DataFrame, key: str, rails: Sequence[str]) -> DataFrame:
    """A running energy integral of a stream of samples (key, t_ms, rails): state is the last time and the joules so far of each key.

    A sample that is no later than the last one counted, of an earlier batch or a second one of its time, is left out."""
    rails = list(rails)
    kind = samples.schema[key].dataType.simpleString()
    out = f"{key} {kind}, t_ms long, energy_j double"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, joules = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values("t_ms")
        for t, *w in rows[["t_ms", *rails]].itertuples(index=False):
            if last is not None and t <= last:
                continue
            joules += 0.0 if last is None else sum(w) * (t - last) / 1000.0
            last = t
        state.update((int(last), float(joules)))
        yield pd.DataFrame([(k[0], int(last), float(joules))], columns=[key, "t_ms", "energy_j"])

    return samples.groupBy(key).applyInPandasWithState(update, out, "last long, joules double", "update", "NoTimeout")


def stream_bursts(events: DataFrame, key: str, least: int) -> DataFrame:
    """T11, W14 on a stream of burst ends (key, ts, dur): bursts longer than least, in one-minute windows with late data up to ten minutes."""
    return long_bursts(events, least).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute"), key).agg(F.count("*").alias("n"), F.sum("dur").alias("dur"))


def detail_policy(bursts: DataFrame, zones: DataFrame, min_dur: int) -> DataFrame:
    """Each burst's level of detail: its zone's policy (none, profile, bursts); bursts under min_dur and those outside zones have none."""
    w = Window.partitionBy("task").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    z = zones.select("task", F.col("t0").alias("ts"), F.lit(None).cast("long").alias("dur"), F.struct("t0", "t1", "policy").alias("_z"), F.lit(0).alias("_side"))
    b = bursts.select("task", "ts", "dur", F.lit(None).cast(z.schema["_z"].dataType).alias("_z"), F.lit(1).alias("_side"))
    both = z.union(b).withColumn("_z", F.last("_z", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("task", "ts", "dur", F.expr(f"case when _z is null or ts >= _z.t1 or dur < {min_dur} then 'none' else _z.policy end").alias("policy"))


def injection_schedule(plans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, loop, round, load) of plans (keys, start, step, rounds, loops): a load that grows by step in each round, and starts again in each loop."""
    looped = plans.where("rounds > 0 and loops > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loops").cast("long") - 1)).alias("loop"))
    rounds = looped.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds").cast("long") - 1)).alias("round"))
    return rounds.select(*keys, "loop", "round", (F.col("start") + F.col("round") * F.col("step")).alias("load"))


def next_frequency(frequency: Column, found: Column) -> Column:
    """An analysis that found nothing waits half as long again."""
    return F.when(found, frequency).otherwise(frequency * 1.5)


def phase_schedule(hits: DataFrame, key: str, first: int, until: int, frequency: float, most: int = 64) -> DataFrame:
    """(key, k, t0, t1, found): the intervals that a trigger has analysed, for each key: the first begins at `first`, each lasts as long as
    the frequency then is; one without a hit (key, time) makes the next half as long again. Ends at `until` or after `most` analyses."""
    kind = hits.schema[key].dataType.simpleString()

    def group(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["time"].to_numpy())
        out, t, f = [], float(first), float(frequency)
        while t < until and len(out) < most:
            found = bool(np.searchsorted(times, t + f, "right") > np.searchsorted(times, t, "right"))
            out.append((k[0], len(out), t, t + f, found))
            t, f = t + f, f if found else 1.5 * f
        return pd.DataFrame(out, columns=[key, "k", "t0", "t1", "found"])

    return hits.select(key, "time").groupBy(key).applyInPandas(group, f"{key} {kind}, k long, t0 double, t1 double, found boolean")


def start_trigger(stream: DataFrame, analyse, frequency: float, checkpoint: str):
    """T1 on a stream: calls analyse(batch, number) on what has come since the last call, every `frequency` seconds; analyse returns whether it found
    something, and after a batch without a find the trigger skips batches until half as long again has passed."""
    state = {"frequency": frequency, "since": None}

    def run(batch: DataFrame, number: int) -> None:
        import time

        now = time.monotonic()
        if state["since"] is not None and now - state["since"] < state["frequency"] - frequency / 2:
            return
        found = analyse(batch, number)
        state["frequency"], state["since"] = (state["frequency"] if found else 1.5 * state["frequency"]), now

    return stream.writeStream.foreachBatch(run).trigger(processingTime=f"{frequency} seconds").option("checkpointLocation", checkpoint).start()


def cluster_bursts(bursts: DataFrame, key: str, features: Sequence[str], radius: float, least: int) -> DataFrame:
    """Bursts with `cluster`, the smallest key of their cluster; null for noise. Density clustering: a burst with `least` bursts or more
    (itself included) within the radius is a core; cores within the radius of each other are one cluster, and other bursts within the radius of a core
    belong to the cluster of the core with the smallest key.

    Bursts are joined with those of neighbouring cells of a grid of the radius's width. Within a cell of one radius over the root of the number
    of features all are near each other, so a cell's bursts are counted, not paired, when they are enough to be cores."""
    features = list(features)
    side = radius / math.sqrt(len(features))
    reach = math.ceil(math.sqrt(len(features)))
    cells = [F.floor(F.col(f) / side).cast("long").alias(f"_c{i}") for i, f in enumerate(features)]
    rows = checkpointed(bursts.select(F.col(key).alias("_k"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], *cells))
    names = [f"_c{i}" for i in range(len(features))]
    full = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs (_k, _o) within the radius, of a row of left and one of right."""
        probe = left
        for i, n in enumerate(names):
            probe = probe.withColumn(f"_p{i}", F.explode(F.array(*[F.col(n) + F.lit(j) for j in range(-reach, reach + 1)])))
        other = right.select(F.col("_k").alias("_o"), *[F.col(f"_x{i}").alias(f"_y{i}") for i in range(len(features))], *[F.col(n).alias(f"_p{i}") for i, n in enumerate(names)])
        d = sum(((F.col(f"_x{i}") - F.col(f"_y{i}")) ** 2 for i in range(len(features))), F.lit(0.0))
        return probe.join(other, [f"_p{i}" for i in range(len(features))]).where(d <= radius * radius).select("_k", "_o")

    sized = rows.join(full, names)
    dense, thin = sized.where(F.col("_n") >= least), sized.where(F.col("_n") < least)
    counted = near(thin, rows).groupBy("_k").agg(F.count("*").alias("_m")).where(F.col("_m") >= least).select("_k")
    core = checkpointed(dense.select("_k").union(counted))
    cores = checkpointed(rows.join(core, "_k"))
    # the cores of a cell are one cluster; cells meet where two of their cores are near
    own = Window.partitionBy(*names)
    marked = checkpointed(cores.withColumn("_cell", F.min("_k").over(own)))
    cell_of = marked.select("_k", "_cell")
    met = near(marked, marked).join(cell_of, "_k").join(cell_of.select(F.col("_k").alias("_o"), F.col("_cell").alias("_other")), "_o").where("_cell <> _other").select(F.col("_cell").alias("a"), F.col("_other").alias("b")).distinct()
    roots = components(met)
    cluster = checkpointed(marked.join(roots.select(F.col("node").alias("_cell"), "root"), "_cell", "left").select("_k", F.coalesce("root", "_cell").alias("cluster")))
    border = near(rows.join(core, "_k", "left_anti"), cores).join(cluster.select(F.col("_k").alias("_o"), "cluster"), "_o").groupBy("_k").agg(F.min_by("cluster", "_o").alias("cluster"))
    return bursts.join(cluster.union(border).withColumnRenamed("_k", key), key, "left")
