"""Monitoring metrics over scopes: warnings, overlaps, episodes and the back-test against events.

Observation metrics come from one aggregate over the rule matrix by grouping sets; notifications,
episodes and events are small beside it and are counted by scenario and rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.measures import absent, amount, first_of, measured, rate
from ..plans.scopes import scoped
from ..plans.shapes import shuffled

if TYPE_CHECKING:
    from .lifecycle import LifecycleConfig

# Metrics of warnings, of overlapping rules, and of events.
WARNING_METRICS = (
    "warning_hit_count", "warning_observation_rate", "warned_entity_count", "warned_entity_rate", "persistent_warning_count", "persistent_warning_rate", "notification_count", "notifications_per_entity", "episode_count",
    "open_episode_count", "resolved_episode_count", "episode_duration_mean", "episode_duration_median",
)
OVERLAP_METRICS = ("overlap_count", "conflict_count")
EVENT_METRICS = ("captured_event_count", "event_recall", "notification_precision", "false_alert_share", "false_positive_rate", "lead_time_mean", "lead_time_median", "warning_to_event_rate")
LOSS_METRICS = ("exposure_sum", "expected_loss_sum", "expected_loss_rate", "observed_loss_sum", "observed_loss_rate")
#: Scopes in which notifications, episodes and events are counted as well.
_FULL = ("overall", "scenario_key", "scenario_key*rule_key")


def persistent_hits(matrix: DataFrame, episodes: DataFrame, config: LifecycleConfig) -> DataFrame:
    """``matrix`` with is_persistent: a hit while its rule's episode is open."""
    rule = [config.entity, "scenario_key", "rule_key"]
    spans = episodes.groupBy(*rule).agg(F.collect_list(F.struct("start_time", "end_time")).alias("_spans"))  # an entity's episodes under one rule
    at = F.col(config.observed)
    inside = F.exists("_spans", lambda e: (e["start_time"] <= at) & (at <= e["end_time"]))
    return matrix.join(shuffled(spans), rule, "left").withColumn("is_persistent", F.coalesce(F.col("truth") & inside, F.lit(False))).drop("_spans")


#: Rules whose bits one long holds.
_WORD = 62


def _distinct(rows: DataFrame, config: LifecycleConfig, what: str, flags: Mapping[str, Column], labels: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """(scope, scenario_key, rule_key, _rank, *labels, *names): how many values of column ``what`` have a flag in each scope.

    A rule is a bit: rows of an observation become one row with a word of bits a flag, so that what is
    exchanged by ``what`` does not multiply by rules, scopes and counts.
    """
    ranks = dict(config.alert_ranks)
    rules = [(s.scenario_key, r.rule_key, ranks[r.alert_level]) for s in config.scenarios for r in s.rules if r.enabled]
    words = range((len(rules) + _WORD - 1) // _WORD)
    bits = {}
    for w in words:
        bit = F.lit(0).cast("long")
        for i, (s, r, k) in enumerate(rules[w * _WORD : (w + 1) * _WORD]):
            bit = F.when((F.col("scenario_key") == s) & (F.col("rule_key") == r) & (F.col("alert_rank") == k), F.lit(1 << i).cast("long")).otherwise(bit)
        bits |= {f"_{f}{w}": F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))) for f, c in flags.items()}
    again = {n: F.bit_or(n) for n in bits}
    own = F.col(f"`{what}`").alias("_what")
    first = [own, *([F.col(f"`{config.entity}`").alias("_entity")] if what != config.entity else []), *[F.col(f"`{c}`").alias(f"_label{i}") for i, c in enumerate(labels)]]
    marks = rows.where(own.isNotNull()).groupBy(*first).agg(*[c.alias(n) for n, c in bits.items()]).repartition(F.col("_what"))

    def counts(marked: DataFrame, cells: list[tuple[str, str | None, str | None, int | None, list[int]]], by: str | None, label: str | None) -> DataFrame:
        def count(flag: str, members: list[int]) -> Column:
            some = F.lit(False)
            for w in words:
                mask = sum(1 << (i - w * _WORD) for i in members if i // _WORD == w)
                if mask:
                    some = some | (F.col(f"_{flag}{w}").bitwiseAND(F.lit(mask).cast("long")) != 0)
            return F.count_if(some)

        wide = marked.groupBy(*([by] if by else [])).agg(*[count(f, m).alias(f"c{i}_{f}") for i, (*_, m) in enumerate(cells) for f in flags])
        text = lambda v: F.lit(v).cast("string")
        structs = [F.struct(F.lit(scope).alias("scope"), text(s).alias("scenario_key"), text(r).alias("rule_key"), text(k).alias("_rank"), *[F.col(f"c{i}_{f}").alias(names[f]) for f in flags]) for i, (scope, s, r, k, _) in enumerate(cells)]
        out = wide.select(*([by] if by else []), F.inline(F.array(*structs)))
        # the labels of other scopes are null, of their own types
        return out.select("scope", "scenario_key", "rule_key", "_rank", *[(F.col(by) if c == label else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in labels], *names.values())

    def held(s: str | None = None, r: str | None = None, k: int | None = None) -> list[int]:
        return [i for i, x in enumerate(rules) if s in (None, x[0]) and r in (None, x[1]) and k in (None, x[2])]

    scenarios = list(dict.fromkeys(x[0] for x in rules))
    plain = [("overall", None, None, None, held()), *[("scenario_key", s, None, None, held(s)) for s in scenarios], *[("scenario_key*rule_key", s, r, None, held(s, r)) for s, r in dict.fromkeys(x[:2] for x in rules)]]
    plain += [("scenario_key*_rank", s, None, k, held(s, None, k)) for s, k in dict.fromkeys((x[0], x[2]) for x in rules)]
    out = counts(marks.groupBy("_what").agg(*[c.alias(n) for n, c in again.items()]), plain, None, None)
    for i, c in enumerate(labels):
        cells = [(f"scenario_key*{c}", s, None, None, held(s)) for s in scenarios]
        out = out.unionByName(counts(marks.groupBy("_what", f"_label{i}").agg(*[v.alias(n) for n, v in again.items()]), cells, f"_label{i}", c))
    return out


def warning_metrics(matrix: DataFrame, episodes: DataFrame, config: LifecycleConfig, extra: tuple[str, ...] = ()) -> DataFrame:
    """13 metrics overall, by scenario and rule; the first six by alert level, segments and ``extra`` columns of the matrix too.

    ``matrix`` has is_persistent, of ``lifecycle.persistent`` or ``persistent_hits``.
    """
    rows = matrix.withColumn("_rank", F.col("alert_rank").cast("string"))
    labels = list(dict.fromkeys([*config.segment_columns, *extra]))
    keys = ["scenario_key", "rule_key", "_rank", *labels]
    sets = [[], ["scenario_key"], ["scenario_key", "rule_key"], *[["scenario_key", k] for k in ("_rank", *labels)]]
    active, hit = F.col("status") != "inactive", F.coalesce(F.col("truth"), F.lit(False))
    counted = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count_if(active).alias("active"), F.count_if(active & hit).alias("hits"))
    wide = scoped(counted, keys, sets, {"active": F.sum("active"), "hits": F.sum("hits")})
    by_key = _distinct(rows, config, config.key, {"rows": active, "hit": active & hit, "persistent": active & F.col("is_persistent")}, labels, {"rows": "rows", "hit": "hit_rows", "persistent": "persistent"})
    by_entity = _distinct(rows, config, config.entity, {"seen": active, "warned": active & hit}, labels, {"seen": "entities", "warned": "warned"})
    for part in (by_key, by_entity):
        renamed = part.select(*[F.col(f"`{c}`").alias(f"_other_{c}") for c in ("scope", *keys)], *[c for c in part.columns if c not in ("scope", *keys)])
        wide = wide.join(F.broadcast(renamed), [F.col(f"`{c}`").eqNullSafe(F.col(f"`_other_{c}`")) for c in ("scope", *keys)], "left").drop(*[f"_other_{c}" for c in ("scope", *keys)])  # a row a scope
    cells = ("active", "hits", "rows", "hit_rows", "entities", "warned", "persistent")
    open_ = F.col("episode_status") == "unresolved"
    lasted = scoped(episodes, ["scenario_key", "rule_key"], sets[:3], {"notes": F.sum("notification_count"), "episodes": F.count(F.lit(1)), "open": F.count_if(open_), "seconds": F.sum("duration_seconds"), "middle": F.percentile("duration_seconds", F.lit(0.5))})
    on = lambda other: [wide["scope"] == other["scope"], wide["scenario_key"].eqNullSafe(other["scenario_key"]), wide["rule_key"].eqNullSafe(other["rule_key"])]
    joined = wide.join(F.broadcast(lasted), on(lasted), "left").drop(lasted["scope"], lasted["scenario_key"], lasted["rule_key"])  # a row a scenario and rule
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in (*cells, "notes", "episodes", "open", "seconds")}
    metrics = {
        "warning_hit_count": amount(c["hits"], c["active"]), "warning_observation_rate": rate(c["hit_rows"], c["rows"], c["rows"]), "warned_entity_count": amount(c["warned"], c["entities"]), "warned_entity_rate": rate(c["warned"], c["entities"], c["entities"]),
        "persistent_warning_count": amount(c["persistent"], c["rows"]), "persistent_warning_rate": rate(c["persistent"], c["rows"], c["rows"]), "notification_count": amount(c["notes"], c["notes"]), "notifications_per_entity": rate(c["notes"], c["entities"], c["entities"]),
        "episode_count": amount(c["episodes"], c["episodes"]), "open_episode_count": amount(c["open"], c["episodes"]), "resolved_episode_count": amount(c["episodes"] - c["open"], c["episodes"]), "episode_duration_mean": rate(c["seconds"], c["episodes"], c["episodes"]),
        "episode_duration_median": first_of([(c["episodes"] == 0, absent("undefined", "zero_denominator"))], amount(F.col("middle"), c["episodes"])),
    }
    tall = measured(joined, ["scope", *keys], metrics)
    part = F.col("scope").isin(*_FULL) | F.col("metric").isin(*WARNING_METRICS[:6])
    return tall.where(part).withColumn("scope", F.regexp_replace("scope", "_rank$", "alert_rank")).withColumnRenamed("_rank", "alert_rank")


def overlap_metrics(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """By scenario: observations on which two rules hit, and on which two rules of the highest rank do."""
    active = F.col("status") != "inactive"
    hit = active & F.coalesce(F.col("truth"), F.lit(False))
    rows = matrix.groupBy("scenario_key", config.key).agg(F.count_if(active).alias("active"), F.sort_array(F.collect_list(F.when(hit, F.col("alert_rank"))), asc=False).alias("ranks"))  # a scenario's rules
    twice = F.size("ranks") >= 2
    wide = rows.where("active > 0").groupBy("scenario_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(twice).alias("overlap"), F.count_if(twice & (F.try_element_at("ranks", F.lit(1)) == F.try_element_at("ranks", F.lit(2)))).alias("conflict"))
    return measured(wide, ["scenario_key"], {"overlap_count": amount(F.col("overlap"), F.col("n")), "conflict_count": amount(F.col("conflict"), F.col("n"))})


def events_by_scenario(events: DataFrame, matches: DataFrame, held: DataFrame, config: LifecycleConfig) -> DataFrame:
    """Every declared event under every scenario: event_status (mature or censored), captured, and its owner if any.

    ``held``: (entity, event_ordinal) of events that a mature observation's horizon could hold.
    """
    scenarios = events.sparkSession.createDataFrame([(s.scenario_key,) for s in config.scenarios], "scenario_key string")
    key = [config.entity, "event_ordinal"]
    every = events.join(shuffled(held.select(*key).distinct().withColumn("_mature", F.lit(True))), key, "left").crossJoin(F.broadcast(scenarios))  # a row a scenario
    owned = matches.select(*key, "scenario_key", "rule_key", "notification_time", "lead_seconds", "candidate_count")
    joined = every.join(shuffled(owned), [*key, "scenario_key"], "left")
    return joined.withColumn("event_status", F.when(F.col("_mature"), "mature").otherwise("censored")).withColumn("captured", F.col("notification_time").isNotNull() & (F.col("event_status") == "mature")).drop("_mature")


def event_metrics(matrix: DataFrame, notes: DataFrame, every: DataFrame | None, maturity: DataFrame | None, primary: DataFrame, config: LifecycleConfig) -> DataFrame:
    """Eight metrics overall, by scenario and by rule; mature cases alone count.  Without events none applies.

    The observations of a rule are those whose primary warning in its scenario is the rule's.
    """
    scopes = scoped(matrix, ["scenario_key", "rule_key"], [[], ["scenario_key"], ["scenario_key", "rule_key"]], {"n": F.count(F.lit(1))}).drop("n")
    if every is None:
        return measured(scopes, ["scope", "scenario_key", "rule_key"], {m: absent("not_applicable", "source_not_requested") for m in EVENT_METRICS})
    sets = [[], ["scenario_key"], ["scenario_key", "rule_key"]]
    as_of = F.lit(config.analysis_as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    caught, lead = F.col("captured"), F.when(F.col("captured"), F.col("lead_seconds"))
    # events have no rule before they are matched: a rule's figures are its scenario's
    found = scoped(every, ["scenario_key"], [[], ["scenario_key"]], {"events": F.count_if(F.col("event_status") == "mature"), "caught": F.count_if(caught), "lead": F.sum(lead), "middle": F.percentile(lead, F.lit(0.5))}).drop("scope")
    owner = every.where("notification_time is not null").select(config.entity, "scenario_key", "rule_key", "notification_time").distinct().withColumn("_matched", F.lit(True))
    ripe = notes.where(F.col("notification_time") + F.lit(config.horizon) <= as_of)
    sent = scoped(ripe.join(shuffled(owner), [config.entity, "scenario_key", "rule_key", "notification_time"], "left"), ["scenario_key", "rule_key"], sets, {"notes": F.count(F.lit(1)), "matched": F.count_if(F.col("_matched"))}).drop("scope")
    seen = maturity.where("is_mature").select(config.key, "event_within_horizon")
    own = seen.join(shuffled(primary.select(config.key, "scenario_key", "rule_key")), config.key)
    held = F.col("event_within_horizon")
    # false positives: mature observations without an event that sent a mature notification
    alarms = ripe.select(F.col("source_key").alias(config.key), "scenario_key", "rule_key").distinct().join(shuffled(seen.where(~held)), config.key).withColumnRenamed("rule_key", "sender")
    total = seen.agg(F.count_if(~held).alias("calm"))
    warned = scoped(own, ["scenario_key", "rule_key"], sets, {"warned": F.count_distinct(config.key), "warned_event": F.count_distinct(F.when(held, F.col(config.key))), "own_calm": F.count_distinct(F.when(~held, F.col(config.key)))}).drop("scope")
    wrong = scoped(alarms, ["scenario_key"], [[], ["scenario_key"]], {"wrong": F.count_distinct(config.key)}).drop("scope")
    by_rule = alarms.join(shuffled(own.select(config.key, "scenario_key", "rule_key")), [config.key, "scenario_key"]).where("sender = rule_key").groupBy("scenario_key", "rule_key").agg(F.count_distinct(config.key).alias("rule_wrong"))
    out = scopes
    for part, keys in ((found, ["scenario_key"]), (sent, ["scenario_key", "rule_key"]), (warned, ["scenario_key", "rule_key"]), (wrong, ["scenario_key"]), (by_rule, ["scenario_key", "rule_key"])):
        renamed = part.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in part.columns if c not in keys])
        out = out.join(F.broadcast(renamed), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])  # a row a scenario and rule
    out = out.crossJoin(F.broadcast(total))  # one row
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("events", "caught", "lead", "notes", "matched", "warned", "warned_event")}
    ruled = F.col("rule_key").isNotNull()
    calm = F.when(ruled, F.coalesce("own_calm", F.lit(0))).otherwise(F.col("calm"))
    false = F.when(ruled, F.coalesce("rule_wrong", F.lit(0))).otherwise(F.coalesce("wrong", F.lit(0)))
    metrics = {
        "captured_event_count": amount(c["caught"], c["events"]), "event_recall": rate(c["caught"], c["events"], c["events"]), "notification_precision": rate(c["matched"], c["notes"], c["notes"]), "false_alert_share": rate(c["notes"] - c["matched"], c["notes"], c["notes"]),
        "false_positive_rate": rate(false, calm, calm), "lead_time_mean": rate(c["lead"], c["caught"], c["caught"]), "lead_time_median": first_of([(c["caught"] == 0, absent("undefined", "zero_denominator"))], amount(F.col("middle"), c["caught"])),
        "warning_to_event_rate": rate(c["warned_event"], c["warned"], c["warned"]),
    }
    return measured(out, ["scope", "scenario_key", "rule_key"], metrics)


def loss_metrics(matrix: DataFrame, config: LifecycleConfig) -> DataFrame:
    """Five metrics by scenario over the observations with a hit.

    The first component that is missing, in the order probability, exposure, loss fraction, gives a sum
    its reason; what was not declared does not apply.
    """
    number = lambda name: F.lit(None).cast("double") if name is None else F.col(f"`{name}`").cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    share = number(config.loss_fraction) if isinstance(config.loss_fraction, str) else F.lit(config.loss_fraction).cast("double")
    hits = matrix.where("truth").select(config.key, "scenario_key", finite(number(config.probability)).alias("p"), finite(number(config.exposure)).alias("x"), finite(share).alias("l"), finite(number(config.observed_loss)).alias("o")).dropDuplicates([config.key, "scenario_key"])
    lacking = {f"no_{c}": F.count_if(F.col(c).isNull()) for c in "pxlo"}
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    wide = hits.groupBy("scenario_key").agg(F.count(F.lit(1)).alias("n"), total("x").alias("sx"), total(F.col("p") * F.col("x") * F.col("l")).alias("sel"), total("o").alias("so"), *[v.alias(k) for k, v in lacking.items()])
    missing = {"p": "probability_unavailable", "x": "exposure_unavailable", "l": "loss_fraction_unavailable", "o": "observed_loss_unavailable"}
    guard = lambda parts, m: first_of([(F.col(f"no_{x}") > 0, absent("not_verifiable", missing[x])) for x in parts], m)
    nothing = absent("not_applicable", "source_not_requested")
    n = F.col("n")
    expected = None not in (config.probability, config.exposure, config.loss_fraction)
    observed = config.observed_loss is not None
    metrics = {
        "exposure_sum": guard("x", amount(F.col("sx"), n)) if config.exposure else nothing,
        "expected_loss_sum": guard("pxl", amount(F.col("sel"), n)) if expected else nothing,
        "expected_loss_rate": guard("pxl", rate(F.col("sel"), F.col("sx"), n)) if expected else nothing,
        "observed_loss_sum": guard("o", amount(F.col("so"), n)) if observed else nothing,
        "observed_loss_rate": guard("ox", rate(F.col("so"), F.col("sx"), n)) if observed and config.exposure else nothing,
    }
    return measured(wide, ["scenario_key"], metrics)


def lifecycle_metrics(history: DataFrame, config: LifecycleConfig) -> DataFrame:
    """(metric, value, ...): share of rows that roll forward, back, enter, reenter, are invalid, and cures among exits of adverse states."""
    kind, way = F.col("transition_kind"), F.col("transition_direction")
    moved = kind.isin("stay", "change", "invalid")
    adverse = F.col("from_state").isin(*config.adverse_states) if config.adverse_states else F.lit(False)
    cells = {
        "n": F.count(F.lit(1)), "moved": F.count_if(moved), "forward": F.count_if(way == "roll_forward"), "back": F.count_if(way == "roll_back"), "entry": F.count_if(kind == "entry"), "reentry": F.count_if(kind == "reentry"),
        "invalid": F.count_if(kind == "invalid"), "adverse": F.count_if(adverse & kind.isin("stay", "change", "reentry")), "cure": F.count_if("is_cure"),
    }
    wide = history.agg(*[v.alias(k) for k, v in cells.items()])
    c = {k: F.col(k) for k in cells}
    metrics = {
        "observation_count": amount(c["n"], c["n"]), "roll_forward_rate": rate(c["forward"], c["moved"], c["moved"]), "roll_back_rate": rate(c["back"], c["moved"], c["moved"]), "cure_rate": rate(c["cure"], c["adverse"], c["adverse"]),
        "entry_count": amount(c["entry"], c["n"]), "reentry_count": amount(c["reentry"], c["n"]), "invalid_transition_rate": rate(c["invalid"], c["moved"], c["moved"]),
    }
    return measured(wide, [], metrics)

