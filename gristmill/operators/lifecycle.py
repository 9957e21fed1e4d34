"""Entity-over-time monitoring: signals, warning episodes, events, states and their summaries.

One key, the entity, carries the whole pipeline: signals are windows over it, rule matrices are
narrow, and the sequential machines fold each entity's ordered rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..plans.conditions import Condition, compile_condition, within_window
from ..plans.scopes import scoped
from ..plans.shapes import shuffled
from .monitoring_tables import event_metrics, events_by_scenario, lifecycle_metrics, loss_metrics, overlap_metrics, warning_metrics

# Derived signals, scenario kinds and period units.
SIGNALS = ("prior_value", "change", "trend", "history_mean", "peer_deviation")
PERIODS = ("day", "week", "month", "quarter")


@dataclass(frozen=True)
class WarningRule:
    rule_key: str
    priority: int
    alert_level: str
    condition: Condition
    persistence: int = 1
    resolution: int = 1
    cooldown: dt.timedelta = dt.timedelta(0)
    enabled: bool = True
    effective_from: dt.datetime | None = None
    expires_at: dt.datetime | None = None


@dataclass(frozen=True)
class WarningScenario:
    scenario_key: str
    scenario_kind: str
    rules: tuple[WarningRule, ...]


@dataclass(frozen=True)
class LifecycleState:
    state_key: str
    state_rank: int
    priority: int
    condition: Condition
    terminal: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class LifecycleConfig:
    analysis_as_of: dt.datetime
    entity: str
    observed: str
    key: str
    feature: str
    scenarios: tuple[WarningScenario, ...]
    reference_scenario: str
    alert_ranks: tuple[tuple[str, int], ...]
    states: tuple[LifecycleState, ...] = ()
    default_state: str = "default"
    unknown_state: str = "unknown"
    allowed_transitions: tuple[tuple[str, str], ...] = ()
    adverse_states: tuple[str, ...] = ()
    cure_states: tuple[str, ...] = ()
    horizon: dt.timedelta = dt.timedelta(days=7)
    horizon_end_inclusive: bool = False
    history_window: dt.timedelta = dt.timedelta(days=7)
    history_start_inclusive: bool = True
    expected_interval: dt.timedelta | None = None
    event_time: str | None = None
    segment_columns: tuple[str, ...] = ()
    period_unit: str = "month"
    #: further columns that signals may be derived from
    features: tuple[str, ...] = ()
    recent_window: dt.timedelta | None = None
    available: str | None = None
    peer_groups: tuple[str, ...] = ()
    peer_start: dt.datetime | None = None
    peer_end: dt.datetime | None = None
    exposure: str | None = None
    probability: str | None = None
    loss_fraction: float | str | None = None
    observed_loss: str | None = None

    def __post_init__(self) -> None:
        if self.peer_start is not None and self.peer_end is not None and self.peer_start > self.peer_end:
            raise ValueError("invalid_peer_period")
        if self.period_unit not in PERIODS:
            raise ValueError("invalid_period_unit")
        if self.reference_scenario not in {s.scenario_key for s in self.scenarios}:
            raise ValueError("unknown_reference_scenario")
        if any(r.alert_level not in dict(self.alert_ranks) for s in self.scenarios for r in s.rules):
            raise ValueError("unknown_alert_level")
        if any(len({r.rule_key for r in s.rules}) != len(s.rules) for s in self.scenarios):
            raise ValueError("duplicate_rule_key")


def micros(column: Column) -> Column:
    """Microseconds of a timestamp without zone."""
    return F.unix_micros(column.cast("timestamp"))


def _us(delta: dt.timedelta) -> int:
    return delta // dt.timedelta(microseconds=1)


def signal_name(kind: str, column: str, window: str = "history") -> str:
    """The column of a derived signal, for conditions to refer to."""
    if kind not in SIGNALS:
        raise ValueError("unknown_signal")
    if window not in ("history", "recent"):
        raise ValueError("unknown_window")
    return f"{kind}({column})" if kind == "peer_deviation" else f"{kind}({column},{window})"


def _referred(config: LifecycleConfig) -> set[str]:
    """Columns that the conditions of rules and states refer to."""

    def walk(c: Condition) -> set[str]:
        out = {c.left} if c.left is not None else set()
        if c.right_kind == "column" and isinstance(c.right, str):
            out.add(c.right)
        return out.union(*map(walk, c.children))

    conditions = [r.condition for s in config.scenarios for r in s.rules] + [s.condition for s in config.states]
    return set().union(*map(walk, conditions))


def _finite(column: str) -> Column:
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def signals(df: DataFrame, config: LifecycleConfig, wanted: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """``df`` with is_consecutive, the four signals of the feature under their plain names, and each of
    ``wanted`` and of the signals that conditions refer to under its ``signal_name``.

    A frame holds the rows before this one, by time and then key, whose time is not before t - w (after
    it, without ``history_start_inclusive``): sums up to the row less sums up to the frame's start, so a
    frame costs no more than a running sum.  Trend is the slope per second.  Signals are null where the
    current value is missing or the frame is empty.
    """
    named = {signal_name(k, c, w): (k, c, w) for k in SIGNALS for c in (config.feature, *config.features) for w in ("history", "recent")}
    asked = {n: named[n] for n in _referred(config) if n in named} | {signal_name(*x): x for x in wanted}
    plain = {k: (k, config.feature, "history") for k in ("prior_value", "change", "history_mean", "trend")}
    rows = df.withColumn("_t", micros(F.col(config.observed)))
    entity = Window.partitionBy(config.entity)
    ordered = entity.orderBy("_t", config.key)
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_x", (F.col("_t") - F.min("_t").over(entity)) / 1e6)
    step = F.col("_t") - F.lag("_t").over(ordered)
    consecutive = F.lit(True) if config.expected_interval is None else step <= _us(config.expected_interval)
    rows = rows.withColumn("is_consecutive", F.when(step.isNotNull(), consecutive))
    for name, (kind, column, window) in (plain | asked).items():
        if kind == "peer_deviation":
            rows = peer_deviation(rows, config, column, name)
            continue
        v = _finite(column)
        x = F.when(v.isNotNull(), F.col("_x"))
        width = config.recent_window if window == "recent" else config.history_window
        if width is None:
            raise ValueError("window_not_declared")
        before = entity.orderBy("_t").rangeBetween(Window.unboundedPreceding, -_us(width) - (1 if config.history_start_inclusive else 0))
        inside = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)) - F.coalesce(F.sum(c).over(before), F.lit(0))  # noqa: B023, E731
        n = F.count(v).over(upto) - F.count(v).over(before)
        prior = F.when(n > 0, F.last(v, ignorenulls=True).over(upto))
        if kind == "prior_value":
            value = prior
        elif kind == "change":
            value = v - prior
        elif kind == "history_mean":
            value = F.when(n > 0, inside(v) / n)
        else:
            sx, sxx = inside(x), inside(x * x)
            spread = sxx - sx * sx / n
            value = F.when((n >= 2) & (spread != 0), (inside(x * v) - sx * inside(v) / n) / spread)
        rows = rows.withColumn(name, F.when(v.isNotNull(), value))
    return rows.drop("_t", "_x")


def peer_deviation(df: DataFrame, config: LifecycleConfig, column: str | None = None, name: str = "peer_deviation") -> DataFrame:
    """``df`` with the value less the mean of its peer group, for rows after the reference period.

    The mean is over finite values, two at least, that are observed within the period and available by
    its end.  Rows with a missing group have none.
    """
    if config.peer_end is None or not config.peer_groups:
        return df.withColumn(name, F.lit(None).cast("double"))
    moment = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    v, at = _finite(column or config.feature), F.col(config.observed)
    inside = at <= moment(config.peer_end)
    if config.peer_start is not None:
        inside = inside & (at >= moment(config.peer_start))
    if config.available is not None:
        inside = inside & (F.col(config.available) <= moment(config.peer_end))
    groups = list(config.peer_groups)
    means = df.where(inside).groupBy(*groups).agg(F.avg(v).alias("_mean"), F.count(v).alias("_n")).where("_n >= 2")
    return df.join(means, groups, "left").withColumn(name, F.when(at > moment(config.peer_end), v - F.col("_mean"))).drop("_mean", "_n")


def period_index(origin: Column, at: Column, unit: str) -> Column:
    """Complete elapsed periods: days of 24 hours, weeks, or calendar months and quarters."""
    if unit in ("day", "week"):
        size = (1 if unit == "day" else 7) * 86_400_000_000
        return F.floor((micros(at) - micros(origin)) / F.lit(size)).cast("long")
    months = (F.year(at) - F.year(origin)) * 12 + F.month(at) - F.month(origin)
    into = lambda c: micros(c) - micros(F.date_trunc("month", c))
    months = months - F.when(into(at) < into(origin), 1).otherwise(0)
    return (months if unit == "month" else F.floor(months / 3)).cast("long")


def rule_matrix(df: DataFrame, config: LifecycleConfig, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each observation, scenario and enabled rule: truth, status, reason and the rule's terms."""
    ranks = dict(config.alert_ranks)
    cells = []
    for i, s in enumerate(config.scenarios):
        for j, r in enumerate(sorted((r for r in s.rules if r.enabled), key=lambda r: (r.priority, r.rule_key))):
            v = within_window(compile_condition(r.condition, df), F.col(config.observed), r.effective_from, r.expires_at)
            cells.append(
                F.struct(
                    F.lit(s.scenario_key).alias("scenario_key"), F.lit(i).alias("scenario_order"), F.lit(r.rule_key).alias("rule_key"), F.lit(j).alias("rule_order"), F.lit(ranks[r.alert_level]).alias("alert_rank"),
                    F.lit(r.persistence).alias("persistence"), F.lit(r.resolution).alias("resolution"), F.lit(_us(r.cooldown)).alias("cooldown"), v.truth.alias("truth"), v.status.alias("status"), v.reason.alias("reason"),
                )
            )
    base = df.select(F.col(config.entity), F.col(config.key), F.col(config.observed), *keep, F.explode(F.array(*cells)).alias("_c"))
    return base.select(config.entity, config.key, config.observed, *keep, "_c.*")


def primary_warnings(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(key, scenario, rule, rank): of an observation's true rules the one of highest rank, then first in order, then by key."""
    best = F.min_by(F.struct("rule_key", "alert_rank"), F.struct(-F.col("alert_rank"), "rule_order", "rule_key"))
    out = matrix.where("truth").groupBy(config.key, "scenario_key").agg(best.alias("_b"), F.count(F.lit(1)).alias("hit_rules"))
    return out.select(config.key, "scenario_key", F.col("_b.rule_key").alias("rule_key"), F.col("_b.alert_rank").alias("alert_rank"), "hit_rules")


def category_ordinals(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """(value, first, ordinal): levels by first appearance, missing last.  A row a level: the levels' order is one task."""
    first = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.min(order_by).alias("first"))
    order = Window.orderBy(F.col("value").isNull(), "first")
    return first.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def time_bucket(column: Column, unit: str) -> Column:
    """Start of the day, ISO week, month or quarter, as a date."""
    if unit not in PERIODS:
        raise ValueError("invalid_period_unit")
    return F.date_trunc(unit, column).cast("date")


def event_summary(events: DataFrame, matches: DataFrame, maturity: DataFrame, matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(scenario, events, captured, recall, mean_lead_seconds, mature_hits, precision): the warnings' back-test.

    Mature events count: those that some mature observation's horizon could hold.  Precision is over
    mature observations with a hit.
    """
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    scenarios = matrix.select("scenario_key").distinct()
    mature = matrix.select(F.col(config.entity), F.col(config.observed)).distinct().where(F.col(config.observed) + F.lit(config.horizon) <= as_of)
    held = _binned(config, mature, F.col(config.observed), True).join(shuffled(_binned(config, events, F.col("event_time"), False)), [config.entity, "_bin"]).where(_inside(config, F.col("event_time"), F.col(config.observed)))
    total = held.select(config.entity, "event_ordinal").distinct().agg(F.count(F.lit(1)).alias("events"))
    captured = matches.groupBy("scenario_key").agg(F.count(F.lit(1)).alias("captured"), F.avg("lead_seconds").alias("mean_lead_seconds"))
    hits = matrix.where("truth").select(config.key, "scenario_key").distinct().join(shuffled(maturity.where("is_mature").select(config.key, "event_within_horizon")), config.key)
    right = hits.groupBy("scenario_key").agg(F.count(F.lit(1)).alias("mature_hits"), F.count_if("event_within_horizon").alias("right_hits"))
    out = scenarios.crossJoin(F.broadcast(total)).join(captured, "scenario_key", "left").join(right, "scenario_key", "left").fillna(0, ["captured", "mature_hits", "right_hits"])
    return out.select("scenario_key", "events", "captured", ratio(F.col("captured"), F.col("events")).alias("recall"), "mean_lead_seconds", "mature_hits", ratio(F.col("right_hits"), F.col("mature_hits")).alias("precision"))


def loss_summary(matrix: DataFrame, config: LifecycleConfig, exposure: str, loss_fraction: float, probability: str) -> DataFrame:
    """(scenario, rows, exposure_sum, expected_loss_sum, expected_loss_rate) over the observations with a hit; a missing component makes a sum null."""
    rows = matrix.where("truth").groupBy(config.key, "scenario_key").agg(F.first(exposure).alias("_ead"), F.first(probability).alias("_pd"))
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    loss = F.col("_pd") * F.col("_ead") * F.lit(loss_fraction)
    out = rows.groupBy("scenario_key").agg(F.count(F.lit(1)).alias("rows"), whole(F.col("_ead")).alias("exposure_sum"), whole(loss).alias("expected_loss_sum"))
    return out.withColumn("expected_loss_rate", ratio(F.col("expected_loss_sum"), F.col("exposure_sum")))


#: The columns that tell one warning machine from another, beside the entity.
_RULE = ("scenario_key", "rule_key", "alert_rank", "persistence", "resolution", "cooldown")


def steps(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """``matrix`` with the warning machine's step at each row: _time, _opens, _closes, _hit (counted in an episode) and _ordinal.

    Rows stay rows: streaks are row numbers less that of the last row that broke them, and an episode is
    open while the last signal to open or close was one to open.  All windows share one order, so a row
    costs the same however long the history is.
    """
    machine = Window.partitionBy(config.entity, *_RULE)
    order = machine.orderBy("_time", "_key", "truth")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = matrix.withColumns({"_time": micros(F.col(config.observed)), "_key": F.col(config.key).cast("long")})
    rows = rows.withColumns({"_row": F.row_number().over(order), "_seen": F.lag("_time").over(order)})
    gap = F.lit(False) if config.expected_interval is None else F.coalesce(F.col("_time") - F.col("_seen") > _us(config.expected_interval), F.lit(False))
    true, false = ~gap & F.col("truth").eqNullSafe(True), ~gap & F.col("truth").eqNullSafe(False)
    rows = rows.withColumns({"_true": true, "_false": false})
    streak = lambda c: F.col("_row") - F.coalesce(F.max(F.when(~F.col(c), F.col("_row"))).over(upto), F.lit(0))
    rows = rows.withColumns({"_t": streak("_true"), "_f": streak("_false")})
    opening, closing = F.col("_true") & (F.col("_t") >= F.col("persistence")), F.col("_false") & (F.col("_f") >= F.col("resolution"))
    rows = rows.withColumn("_signal", F.when(opening, True).when(closing, False))
    rows = rows.withColumn("_was", F.coalesce(F.last("_signal", ignorenulls=True).over(before), F.lit(False)))
    signal = F.coalesce("_signal", F.lit(False))
    rows = rows.withColumns({"_opens": signal & ~F.col("_was"), "_closes": F.col("_was") & F.coalesce(~F.col("_signal"), F.lit(False))})
    rows = rows.withColumns({"_ordinal": F.count_if("_opens").over(upto) - 1, "_hit": F.col("_opens") | (F.col("_was") & F.col("_true"))})
    return rows.drop("_row", "_seen", "_false", "_t", "_f", "_signal", "_key", "_true")


def persistent(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """``matrix`` with is_persistent: a hit at a time at which its rule's episode is open, as ``persistent_hits`` finds it by spans.

    A time lies in an episode if one of its rows does; an episode that stays open ends at the analysis time.
    """
    as_of = micros(F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
    machine = Window.partitionBy(config.entity, *_RULE)
    rows = steps(matrix, config).withColumn("_closed", F.count_if("_closes").over(machine))
    within = F.col("_hit") | F.col("_was")
    rows = rows.withColumn("_in", within & ((F.col("_closed") > F.col("_ordinal")) | (F.col("_time") <= as_of)))
    there = F.max("_in").over(Window.partitionBy(config.entity, *_RULE, "_time"))
    return rows.select(*matrix.columns, F.coalesce(F.col("truth") & F.col("_time").isNotNull() & there, F.lit(False)).alias("is_persistent"))


def machines(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """One row an episode of the warning machine: ordinal, start, end, resolved, hits, suppressed, and its notes (time, key).

    A gap longer than the expected interval clears both streaks and skips its row.  An episode opens
    after ``persistence`` trues and closes after ``resolution`` falses; an unknown clears the streaks
    and keeps it.  While it is open, trues notify again once the cooldown since the last notification
    has passed.  Only the cooldown is a fold, over the hits of one episode.
    """
    rows = steps(matrix, config).where(F.col("_hit") | F.col("_closes"))
    one = F.when(F.col("_hit"), F.struct(F.col("_time").alias("time"), F.col(config.key).cast("long").alias("key")))
    found = rows.groupBy(config.entity, *_RULE, F.col("_ordinal").alias("ordinal")).agg(
        F.min(F.when(F.col("_opens"), F.col("_time"))).alias("start"), F.max(F.when(F.col("_closes"), F.col("_time"))).alias("end"), F.bool_or("_closes").alias("resolved"), F.count_if("_hit").alias("hits"), F.sort_array(F.collect_list(one)).alias("_hits"),
    )
    first = F.slice("_hits", 1, 1)
    later = lambda out, x: F.when(x["time"] - F.element_at(out, -1)["time"] >= F.col("cooldown"), F.concat(out, F.array(x))).otherwise(out)
    notes = F.when(F.col("start").isNull(), first).when(F.col("cooldown") <= 0, F.col("_hits")).otherwise(F.aggregate(F.slice("_hits", F.lit(2), F.greatest(F.size("_hits") - 1, F.lit(0))), first, later))
    found = found.withColumn("notes", notes).drop("_hits")
    return found.withColumn("suppressed", F.when(F.col("start").isNull(), F.lit(0).cast("long")).otherwise(F.col("hits") - F.size("notes")))


def _time(column: Column) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def notifications(folded: DataFrame, config: LifecycleConfig) -> DataFrame:
    rows = folded.select(config.entity, "scenario_key", "rule_key", "alert_rank", "ordinal", F.posexplode("notes").alias("_p", "_n"))
    kind = F.when(F.col("_p") > 0, "repeated").when(F.col("ordinal") > 0, "episode_reopen").otherwise("episode_open")
    return rows.select(config.entity, "scenario_key", "rule_key", "alert_rank", F.col("ordinal").alias("episode_ordinal"), F.col("_p").cast("long").alias("notification_ordinal"), kind.alias("notification_kind"), _time(F.col("_n.time")).alias("notification_time"), F.col("_n.key").alias("source_key"))


def episodes(folded: DataFrame, config: LifecycleConfig) -> DataFrame:
    """Closed episodes, and those open at the end, which last until the analysis time."""
    end = F.when(F.col("resolved"), F.col("end")).otherwise(micros(F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")))
    return folded.select(
        config.entity, "scenario_key", "rule_key", "alert_rank", F.col("ordinal").alias("episode_ordinal"), _time(F.col("start")).alias("start_time"), _time(end).alias("end_time"),
        F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("episode_status"), F.col("hits").alias("hit_count"), F.size("notes").cast("long").alias("notification_count"), F.col("suppressed").alias("suppressed_count"), ((end - F.col("start")) / 1e6).alias("duration_seconds"),
    )


def declared_events(df: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(entity, event_time, event_ordinal): distinct events up to the analysis time."""
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = df.select(F.col(config.entity), F.col(config.event_time).alias("event_time")).where(F.col("event_time").isNotNull() & (F.col("event_time") <= as_of)).distinct()
    return rows.withColumn("event_ordinal", (F.row_number().over(Window.partitionBy(config.entity).orderBy("event_time")) - 1).cast("long"))


def _inside(config: LifecycleConfig, event: Column, start: Column) -> Column:
    end = start + F.lit(config.horizon)
    return (event > start) & ((event <= end) if config.horizon_end_inclusive else (event < end))


def _binned(config: LifecycleConfig, df: DataFrame, time: Column, both: bool) -> DataFrame:
    """With _bin, by horizon: an interval touches two bins at most, so matches meet in equal bins."""
    size = max(1, _us(config.horizon))
    at = F.floor(micros(time) / F.lit(size)).cast("long")
    return df.withColumn("_bin", F.explode(F.array(at, at + 1)) if both else at)


def event_matches(notes: DataFrame, events: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(entity, event, scenario, rule, ...): the earliest mature notification whose horizon holds the event.

    A range join on entity and horizon-sized time bins, so an entity's history is never crossed with
    all of its events.
    """
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    mature = notes.where(F.col("notification_time") + F.lit(config.horizon) <= as_of)
    left = _binned(config, mature, F.col("notification_time"), True)
    right = _binned(config, events, F.col("event_time"), False)
    joined = left.join(shuffled(right), [config.entity, "_bin"]).where(_inside(config, F.col("event_time"), F.col("notification_time")))
    first = F.min_by(F.struct("rule_key", "notification_time"), F.struct("notification_time", "rule_key", "notification_ordinal"))
    out = joined.groupBy(config.entity, "event_ordinal", "event_time", "scenario_key").agg(first.alias("_o"), F.count(F.lit(1)).alias("candidate_count"))
    lead = (micros(F.col("event_time")) - micros(F.col("_o.notification_time"))) / 1e6
    return out.select(config.entity, "event_ordinal", "event_time", "scenario_key", F.col("_o.rule_key").alias("rule_key"), F.col("_o.notification_time").alias("notification_time"), lead.alias("lead_seconds"), "candidate_count")


def observation_maturity(df: DataFrame, events: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(key, is_mature, event_within_horizon): the horizon ends by the analysis time; whether an event lies in it."""
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = df.select(F.col(config.entity), F.col(config.key), F.col(config.observed))
    hit = _binned(config, rows, F.col(config.observed), True).join(shuffled(_binned(config, events, F.col("event_time"), False)), [config.entity, "_bin"]).where(_inside(config, F.col("event_time"), F.col(config.observed))).select(config.key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(shuffled(hit), config.key, "left").select(config.key, config.entity, (F.col(config.observed) + F.lit(config.horizon) <= as_of).alias("is_mature"), F.coalesce("_hit", F.lit(False)).alias("event_within_horizon"))


def states(df: DataFrame, config: LifecycleConfig) -> DataFrame:
    """One row an observation: candidate and effective state and the transition into it.

    The candidate is the true state of lowest (priority, key); unknown when none is true and one is
    unknown; else the default.  Exits of terminal states and transitions outside the list are invalid
    and keep the state, yet time moves on.  After a gap the candidate is always taken.
    """
    rank = {s.state_key: s.state_rank for s in config.states} | {config.default_state: next((s.state_rank for s in config.states if s.state_key == config.default_state), 0), config.unknown_state: next((s.state_rank for s in config.states if s.state_key == config.unknown_state), -1)}
    held = [s for s in config.states if s.enabled and s.state_key != config.unknown_state and s.state_key != config.default_state]
    verdicts = [(s, compile_condition(s.condition, df)) for s in sorted(held, key=lambda s: (s.priority, s.state_key))]
    candidate = F.coalesce(*[F.when(v.truth, F.lit(s.state_key)) for s, v in verdicts], F.when(_any([v.truth.isNull() for _, v in verdicts]), F.lit(config.unknown_state)), F.lit(config.default_state))
    step = F.struct(micros(F.col(config.observed)).alias("time"), F.col(config.key).cast("long").alias("key"), candidate.alias("candidate"))
    grouped = df.select(config.entity, step.alias("_s")).groupBy(config.entity).agg(F.array_sort(F.collect_list("_s")).alias("steps"))
    ranks = F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])
    terminal = [s.state_key for s in config.states if s.terminal]
    interval = None if config.expected_interval is None else _us(config.expected_interval)
    row = "struct<time:long,key:long,candidate:string,previous:string,effective:string,kind:string,direction:string,allowed:boolean,cure:boolean>"
    kind = f"struct<state:string,seen:long,out:array<{row}>>"

    def fold(s: Column, x: Column) -> Column:
        c, p = x["candidate"], s["state"]
        gap = F.lit(False) if interval is None else x["time"] - s["seen"] > interval
        listed = F.lit(True) if not config.allowed_transitions else F.concat_ws("\0", p, c).isin([f"{a}\0{b}" for a, b in config.allowed_transitions])
        leaving = p.isin(terminal) if terminal else F.lit(False)
        what = F.when(p.isNull(), "entry").when(gap, "reentry").when(c == p, "stay").when(leaving | ~listed, "invalid").otherwise("change")
        effective = F.when(what == "invalid", p).otherwise(c)
        way = F.when(what == "stay", "flat").when(what == "change", F.when(ranks[c] > ranks[p], "roll_forward").when(ranks[c] < ranks[p], "roll_back").otherwise("flat")).otherwise("not_applicable")
        cure = F.coalesce(what.isin("change", "reentry") & (p.isin(list(config.adverse_states)) if config.adverse_states else F.lit(False)) & (c.isin(list(config.cure_states)) if config.cure_states else F.lit(False)), F.lit(False))
        entry = F.struct(x["time"].alias("time"), x["key"].alias("key"), c.alias("candidate"), p.alias("previous"), effective.alias("effective"), what.alias("kind"), way.alias("direction"), (what != "invalid").alias("allowed"), cure.alias("cure"))
        return F.struct(effective.alias("state"), x["time"].alias("seen"), F.concat(s["out"], F.array(entry)).alias("out")).cast(kind)

    out = grouped.select(config.entity, F.explode(F.aggregate("steps", F.from_json(F.lit('{"out":[]}'), kind), fold, lambda s: s["out"])).alias("_r"))
    return out.select(
        config.entity, F.col("_r.key").alias(config.key), _time(F.col("_r.time")).alias("transition_time"), F.col("_r.candidate").alias("candidate_state"), F.col("_r.previous").alias("from_state"), F.col("_r.effective").alias("effective_state"),
        F.col("_r.kind").alias("transition_kind"), F.col("_r.direction").alias("transition_direction"), F.col("_r.allowed").alias("is_allowed"), F.col("_r.cure").alias("is_cure"),
    )


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def transition_summary(history: DataFrame) -> DataFrame:
    """(from_state, effective_state, kind, direction, transitions, rate): rate among the rows that leave from_state."""
    counted = history.groupBy("from_state", "effective_state", "transition_kind", "transition_direction").agg(F.count(F.lit(1)).alias("transitions"), F.count_if("is_cure").alias("cures"))
    total = counted.groupBy(F.col("from_state").alias("_from")).agg(F.sum("transitions").alias("total"))
    return counted.join(F.broadcast(total), F.col("from_state").eqNullSafe(F.col("_from"))).select("from_state", "effective_state", "transition_kind", "transition_direction", "transitions", "cures", ratio(F.col("transitions"), F.col("total")).alias("rate"))


def state_summary(history: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(state, observations, entities, rate, seconds): seconds until the next observation, at the end until the analysis time."""
    as_of = micros(F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
    t = micros(F.col("transition_time"))
    following = F.coalesce(F.lead(t).over(Window.partitionBy(config.entity).orderBy("transition_time", config.key)), as_of)
    rows = history.withColumn("_seconds", (following - t) / 1e6)
    counted = rows.groupBy(F.col("effective_state").alias("state")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(config.entity).alias("entities"), F.sum("_seconds").alias("seconds_in_state"))
    total = counted.agg(F.sum("observations").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("state", "observations", "entities", ratio(F.col("observations"), F.col("total")).alias("rate"), "seconds_in_state")


def monitoring_summary(matrix: DataFrame, folded: DataFrame, config: LifecycleConfig) -> DataFrame:
    """Warning counts by scope: scenario, rule within it, and segments of the observations."""
    segments = list(config.segment_columns)
    keys = ["scenario_key", "rule_key", *segments]
    sets = [["scenario_key"], ["scenario_key", "rule_key"], *[["scenario_key", s] for s in segments]]
    counts = scoped(matrix, keys, sets, {"evaluations": F.count(F.lit(1)), "hits": F.count_if("truth"), "unknowns": F.count_if(F.col("truth").isNull()), "hit_rows": F.count_distinct(F.when(F.col("truth"), F.col(config.key))), "hit_entities": F.count_distinct(F.when(F.col("truth"), F.col(config.entity)))})
    return counts.withColumn("hit_rate", ratio(F.col("hits"), F.col("evaluations")))


def episode_summary(folded: DataFrame, config: LifecycleConfig) -> DataFrame:
    rows = episodes(folded, config)
    counts = scoped(rows, ["scenario_key", "rule_key"], [["scenario_key"], ["scenario_key", "rule_key"]], {"episodes": F.count(F.lit(1)), "resolved": F.count_if(F.col("episode_status") == "resolved"), "notifications": F.sum("notification_count"), "suppressed": F.sum("suppressed_count"), "entities": F.count_distinct(config.entity), "mean_seconds": F.avg("duration_seconds")})
    return counts


def scenario_comparison(summary: DataFrame, config: LifecycleConfig, metrics: Sequence[str] = ("hits", "hit_rate")) -> DataFrame:
    """Each scenario's figures against the reference's, where both evaluated as many rows."""
    rows = summary.where("scope = 'scenario_key'")
    tall = rows.select("scenario_key", "evaluations", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    base = tall.where(F.col("scenario_key") == config.reference_scenario).select("metric", F.col("value").alias("reference_value"), F.col("evaluations").alias("reference_support"))
    joined = tall.where(F.col("scenario_key") != config.reference_scenario).join(F.broadcast(base), "metric", "left")
    same = F.col("evaluations") == F.col("reference_support")
    return joined.select("scenario_key", "metric", "value", "reference_value", F.when(same, F.col("value") - F.col("reference_value")).alias("difference"), F.when(same, "available").otherwise("not_verifiable").alias("status"), F.when(same, "computed").otherwise("support_not_comparable").alias("reason"))


def vintages(df: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(cohort, period_index, observations, entities, mean_value): cohorts by the month of an entity's first row."""
    first = F.min(config.observed).over(Window.partitionBy(config.entity))
    rows = df.withColumn("_origin", first).withColumn("cohort", F.date_trunc("month", "_origin").cast("date")).withColumn("period_index", period_index(F.col("_origin"), F.col(config.observed), config.period_unit))
    return rows.groupBy("cohort", "period_index").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(config.entity).alias("entities"), F.avg(config.feature).alias("mean_value"))


def held_events(df: DataFrame, events: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(entity, event_ordinal) of the events that a mature observation's horizon holds."""
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    mature = df.select(F.col(config.entity), F.col(config.observed)).where(F.col(config.observed) + F.lit(config.horizon) <= as_of)
    joined = _binned(config, mature, F.col(config.observed), True).join(shuffled(_binned(config, events, F.col("event_time"), False)), [config.entity, "_bin"])
    return joined.where(_inside(config, F.col("event_time"), F.col(config.observed))).select(config.entity, "event_ordinal").distinct()


@dataclass(frozen=True)
class LifecycleResult:
    config: LifecycleConfig
    signals: DataFrame
    rule_matrix: DataFrame
    notifications: DataFrame
    episodes: DataFrame
    #: every declared event under every scenario, matched or not
    event_matches: DataFrame | None
    maturity: DataFrame | None
    states: DataFrame | None
    transitions: DataFrame | None
    state_summary: DataFrame | None
    lifecycle_metrics: DataFrame | None
    monitoring_summary: DataFrame
    warning_metrics: DataFrame
    overlap_metrics: DataFrame
    event_metrics: DataFrame
    loss_metrics: DataFrame
    episode_summary: DataFrame
    scenario_comparison: DataFrame
    vintages: DataFrame


def monitor_lifecycle(df: DataFrame, config: LifecycleConfig) -> LifecycleResult:
    """All tables of a monitoring run, lazily."""
    with_signals = signals(df.repartition(F.col(config.entity)), config)  # one exchange before rows multiply by rules
    named = [c for c in (config.exposure, config.probability, config.loss_fraction if isinstance(config.loss_fraction, str) else None, config.observed_loss) if c]
    matrix = rule_matrix(with_signals, config, list(dict.fromkeys([*config.segment_columns, *named])))
    folded = machines(matrix, config)
    notes, spans = notifications(folded, config), episodes(folded, config)
    events = declared_events(df, config) if config.event_time else None
    matched = ripe = None
    if events is not None:
        matched = events_by_scenario(events, event_matches(notes, events, config), held_events(df, events, config), config)
        ripe = observation_maturity(df, events, config)
    history = states(with_signals, config) if config.states else None
    summary = monitoring_summary(matrix, folded, config)
    return LifecycleResult(
        config, with_signals, matrix, notes, spans, matched, ripe, history, transition_summary(history) if history is not None else None, state_summary(history, config) if history is not None else None,
        lifecycle_metrics(history, config) if history is not None else None, summary, warning_metrics(persistent(matrix, config), spans, config), overlap_metrics(matrix, config),
        event_metrics(matrix, notes, matched, ripe, primary_warnings(matrix, config), config), loss_metrics(matrix, config), episode_summary(folded, config), scenario_comparison(summary, config), vintages(df, config),
    )
