"""Composite results: a state with evidence, an action, confidence and sample quality, as one row each.

Inputs are one-row aggregates over windows of the range, joined side by side; labels are expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import exprs as X
from pulsegrid.operators import context, daily, sleep
from pulsegrid.operators import workouts as W
from pulsegrid.plans.ranges import DateRange, Windows, composite_windows

TARGET_SLEEP_HOURS = 8.0
# How much an action, a confidence, a quality and a claim weigh when results are ranked.
ACTIONS = {"reduce_intensity": 7, "run_easier": 6, "add_sleep": 5, "retest": 4, "watch": 3, "maintain": 2, "push": 1}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
QUALITY = {"high": 3, "mixed": 2, "poor": 1}
CLAIMS = {"measured": 4, "likely": 3, "suggests": 2, "worth_watching": 1}
DIAGNOSES = {"cardiac_drift": 5, "under_recovered": 4, "pacing_fade": 3, "poor_sample_quality": 2, "clean_aerobic": 1}
EVIDENCE = "array<struct<label:string,value_text:string,value_num:double>>"
# Our own words for each kind of action.
ADVICE = {
    "reduce_intensity": "Take intensity or volume down until the signals settle.",
    "run_easier": "Keep the next runs easy and look at the signal again.",
    "add_sleep": "Sleep more before the next hard session.",
    "retest": "Collect better sampled data first.",
    "watch": "Wait for other signals to agree.",
    "maintain": "Carry on as planned.",
    "push": "A normal hard session is fine.",
}

c = F.col


def _beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def _covering(ranges: dict[str, DateRange]) -> DateRange:
    """The days from the first to the last of some ranges of days."""
    return DateRange(min(r.start for r in ranges.values()), max(r.end for r in ranges.values()))


def _on(r: DateRange) -> Column:
    first, last = r.days()
    return c("day").between(F.lit(first), F.lit(last))


def _over(series: DataFrame, aggregate, value: str, **ranges: DateRange) -> list[Column]:
    """An aggregate of a daily series for each named range of days."""
    return [aggregate(F.when(_on(r), c(value))).alias(name) for name, r in ranges.items()]


def _means(series, t, value: str, **ranges: DateRange) -> DataFrame:
    """Mean of a daily series over each named range of days, from one scan of its table."""
    days = series(t, _covering(ranges))
    return days.agg(*_over(days, F.avg, value, **ranges))


def _rhr(t, **ranges: DateRange) -> DataFrame:
    return _means(daily.resting_hr_daily, t, "avg_rhr", **ranges)


def _hrv(t, **ranges: DateRange) -> DataFrame:
    return _means(daily.hrv_daily, t, "avg_hrv", **ranges)


def _loads(t, **ranges: DateRange) -> DataFrame:
    """Sum of load over each named range, from one join of its workouts and the heart rate; those without samples add nothing."""
    inside = {name: X.within("start_ts", r) for name, r in ranges.items()}
    loads = W.loads(t, t.workouts.filter(reduce(lambda a, b: a | b, inside.values())))
    return loads.agg(*[F.sum(F.when(mine, c("load"))).alias(name) for name, mine in inside.items()])


def _pace(t, pace: bool = True, decoupling: bool = True, **ranges: DateRange) -> DataFrame:
    """Mean pace, how many running workouts have one, and mean decoupling, as far as asked for, for each named range; aligned once for all."""
    inside = {name: X.within("start_ts", r) for name, r in ranges.items()}
    runs = t.running.filter(reduce(lambda a, b: a | b, inside.values()))
    paces = lambda name, mine: [f(F.when(mine, c("pace_sec_per_km"))).alias(f"{name}_{x}") for x, f in (("pace", F.avg), ("runs", F.count))]
    means = lambda name, mine: paces(name, mine) * pace + [F.avg(F.when(mine, c("decoupling_pct"))).alias(f"{name}_decoupling")] * decoupling
    return W.pace_and_decoupling(t, runs, pace, decoupling).agg(*[x for name, mine in inside.items() for x in means(name, mine)])


def _case(value: Column, **cases: str) -> Column:
    rest = cases.pop("other")
    out = F.lit(rest)
    for when, then in cases.items():
        out = F.when(value == when.replace("_", " "), then).otherwise(out)
    return out


def _evidence(*items: tuple[str, Column, str]) -> Column:
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.array(
        *[F.struct(F.lit(label).alias("label"), (v if kind == "text" else text).alias("value_text"), (v.cast("double") if kind == "num" else num).alias("value_num")) for label, v, kind in items]
    ).cast(EVIDENCE)


def _result(df: DataFrame, state: Column, action: Column, quality: Column, claim: Column, evidence: Column, *extra: str) -> DataFrame:
    df = df.withColumn("state", state).withColumn("action_kind", action).withColumn("sample_quality", quality)
    advice = F.lit(None).cast("string")
    for kind, words in ADVICE.items():
        advice = F.when(c("action_kind") == kind, words).otherwise(advice)
    return df.select(
        "state",
        "action_kind",
        advice.alias("recommendation"),
        F.when(c("sample_quality") == "high", "high").when(c("sample_quality") == "mixed", "medium").otherwise("low").alias("confidence"),
        "sample_quality",
        claim.alias("claim_strength"),
        evidence.alias("evidence"),
        *extra,
    )


def _settled(x: Column) -> Column:
    """Sums over samples differ with their order in the last digits; so that these decide no tie, nine places are kept before texts are made."""
    return F.round(x, 9)


def _fixed(x: Column, digits: int) -> Column:
    return X.fixed(_settled(x), digits)


def _signed(x: Column, digits: int, unit: str = "") -> Column:
    return X.signed(_settled(x), digits, unit)


def _signal(direction: Column) -> Column:
    return F.when(direction == "declining", 1).when(direction == "improving", -1).otherwise(0)


def _bad(direction: Column) -> Column:
    return F.when(direction == "declining", 1).otherwise(0)



def _suggests():
    return F.lit("suggests")


def readiness(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    df = _beside(_rhr(t, rhr=w.current, rhr0=w.baseline), _hrv(t, hrv=w.current, hrv0=w.baseline), sleep.summary(t, w.current), _loads(t, load=w.current, load0=w.baseline))
    return _readiness(df, w)


def _readiness(df: DataFrame, w: Windows, *kept: str) -> DataFrame:
    hours = c("total_hours") / float(w.current.n_days)
    poor = (hours < 7) | F.coalesce(c("efficiency") < 0.85, F.lit(False))
    score = _signal(X.trend(c("rhr"), c("rhr0"), False)) + _signal(X.trend(c("hrv"), c("hrv0"))) + F.when(poor, 1).when(hours >= 8, -1).otherwise(0) + _signal(X.trend(c("load"), c("load0"), False))
    df = df.withColumn("score", score).withColumn("sleep_hours_per_day", hours)
    state = F.when(c("score") >= 2, "Strained").when(c("score") <= -1, "Fresh").otherwise("Normal")
    quality = F.when(c("rhr").isNull() | c("hrv").isNull(), "poor").when(c("rhr0").isNull() | c("hrv0").isNull(), "mixed").otherwise("high")
    found = _evidence(
        ("Resting HR", _signed(c("rhr") - c("rhr0"), 1, " bpm"), "text"),
        ("HRV", _signed(c("hrv") - c("hrv0"), 1, " ms"), "text"),
        ("Sleep", F.concat(_fixed(c("sleep_hours_per_day"), 1), F.lit(" h/night")), "text"),
        ("Training load", _signed(c("load") - c("load0"), 1), "text"),
    )
    return _result(df, state, _case(c("state"), Fresh="push", Strained="reduce_intensity", other="maintain"), quality, _suggests(), found, "score", "sleep_hours_per_day", *kept)


def _strain_inputs(t, w):
    return _beside(_loads(t, acute=w.acute7d, chronic=w.chronic28d), _rhr(t, rhr=w.acute7d, rhr0=w.baseline), _hrv(t, hrv=w.acute7d, hrv0=w.baseline))


def training_strain(t, r: DateRange) -> DataFrame:
    return _training_strain(_strain_inputs(t, composite_windows(r)))


def _training_strain(df: DataFrame, *kept: str) -> DataFrame:
    df = df.withColumn("load_ratio", X.ratio(c("acute"), c("chronic") / 4))
    penalty = _bad(X.trend(c("rhr"), c("rhr0"), False)) + _bad(X.trend(c("hrv"), c("hrv0")))
    df = df.withColumn("penalty", penalty)
    ratio, p = c("load_ratio"), c("penalty")
    state = (
        F.when(ratio.isNull(), "unclear")
        .when((ratio > 1.3) | (p >= 2) | ((ratio > 1.1) & (p >= 1)), "excessive")
        .when(ratio.between(0.8, 1.3) & (p == 0), "productive")
        .otherwise("moderate")
    )
    quality = (
        F.when(ratio.isNull(), "poor").when(c("rhr").isNull() | c("rhr0").isNull() | c("hrv").isNull() | c("hrv0").isNull(), "mixed").otherwise("high")
    )
    found = _evidence(
        ("Acute:chronic load", X.fixed_number(_settled(ratio), 2), "num"),
        ("Recovery penalty", p, "num"),
        ("Resting HR", _signed(c("rhr") - c("rhr0"), 1, " bpm"), "text"),
        ("HRV", _signed(c("hrv") - c("hrv0"), 1, " ms"), "text"),
    )
    return _result(df, state, _case(c("state"), productive="push", excessive="reduce_intensity", other="maintain"), quality, _suggests(), found, "load_ratio", "penalty", *kept)


def recovery_debt(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    return _recovery_debt(_strain_inputs(t, w).crossJoin(sleep.summary(t, w.acute7d)), w)


def _recovery_debt(df: DataFrame, w: Windows, *kept: str) -> DataFrame:
    df = df.withColumn("load_ratio", X.ratio(c("acute"), c("chronic") / 4))
    zero = F.lit(0.0)
    delta = lambda a: F.coalesce(c(a) - c(a + "0"), zero)
    df = df.withColumn("sleep_debt", F.greatest(zero, F.lit(TARGET_SLEEP_HOURS * w.acute7d.n_days) - c("total_hours"))).withColumn("d_rhr", delta("rhr")).withColumn("d_hrv", delta("hrv"))
    ratio = c("load_ratio")
    debt = c("sleep_debt") + F.greatest(zero, c("d_rhr")) / 2 + F.greatest(zero, -c("d_hrv")) / 5 + F.greatest(zero, F.coalesce(ratio, F.lit(1.0)) - 1) * 4
    signals = sum(F.when(x, 1).otherwise(0) for x in (c("sleep_debt") >= 4, c("d_rhr") >= 3, c("d_hrv") <= -8, ratio >= 1.2))
    now = (c("total_hours") > 0) | c("rhr").isNotNull() | c("hrv").isNotNull()
    loaded = c("acute").isNotNull() | c("chronic").isNotNull()
    quality = F.when(~now & ~loaded, "poor").when(c("rhr0").isNull() | c("hrv0").isNull() | ~loaded, "mixed").otherwise("high")
    df = df.withColumn("quality", quality)
    poor = c("quality") == "poor"
    df = df.withColumn("debt_score", F.when(~poor, debt)).withColumn("fatigue_signals", F.when(~poor, signals))
    score, n = c("debt_score"), c("fatigue_signals")
    state = F.when(poor, "needs more data").when((score >= 7) & (n >= 2), "accumulating").when((score >= 3) & (n <= 1), "short-term dip").when(score >= 3, "moderate").otherwise("low")
    action = F.when(poor, "retest").when(c("state") == "accumulating", "reduce_intensity").when(c("state") == "short-term dip", "add_sleep").when(c("state") == "moderate", "run_easier").otherwise("maintain")
    show = lambda a, name, unit: F.when((c(a) - c(a + "0")).isNull(), f"{name} unknown").otherwise(F.concat(F.lit(name + " "), _signed(c(a) - c(a + "0"), 1, unit)))
    both = (c("rhr") - c("rhr0")).isNull() & (c("hrv") - c("hrv0")).isNull()
    full = _evidence(
        ("Debt score", X.fixed_number(_settled(score), 1), "num"),
        ("Sleep deficit", F.concat(_fixed(c("sleep_debt"), 1), F.lit(" h")), "text"),
        ("Recovery markers", F.when(~both, F.concat_ws(", ", show("rhr", "RHR", " bpm"), show("hrv", "HRV", " ms"))), "text"),
        ("Training load", X.fixed_number(_settled(ratio), 2), "num"),
    )
    none = F.lit(None).cast("double")
    empty = _evidence(("Sleep deficit", none, "num"), ("Recovery markers", none, "num"), ("Training load", none, "num"))
    return _result(df, state, action, c("quality"), F.when(poor, "worth_watching").otherwise("suggests"), F.when(poor, empty).otherwise(full), "debt_score", "fatigue_signals", *kept)


def _form(t, w: Windows) -> DataFrame:
    """Means of VO2 max and power over the range and the one before it."""
    both = {"": w.current, "0": w.baseline}
    days = daily.daily_mean(t.performance, {"vo2max": "vo2", "power": "power"}, _covering(both))
    return days.agg(*[x for name in ("vo2", "power") for x in _over(days, F.avg, name, **{name + k: r for k, r in both.items()})])


def fitness_trend(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    return _fitness_trend(_beside(_form(t, w), _rhr(t, rhr=w.current, rhr0=w.baseline), _pace(t, decoupling=False, cur=w.current, base=w.baseline)))


def _fitness_trend(df: DataFrame, *kept: str) -> DataFrame:
    df = (
        df.withColumn("t_vo2", X.trend(c("vo2"), c("vo20")))
        .withColumn("t_pace", X.trend(c("cur_pace"), c("base_pace"), False, 0.02))
        .withColumn("t_power", X.trend(c("power"), c("power0")))
        .withColumn("t_rhr", X.trend(c("rhr"), c("rhr0"), False))
    )
    names = ["t_vo2", "t_pace", "t_power", "t_rhr"]
    df = df.withColumn("score", -sum(_signal(c(n)) for n in names))
    unknown = reduce(lambda a, b: a & b, [c(n) == "insufficient_data" for n in names])
    state = F.when(c("score") >= 2, "Improving").when(c("score") <= -2, "Declining").when(unknown, "Unclear").otherwise("Flat")
    others = reduce(lambda a, b: a | b, [c(n) == "improving" for n in names[1:]])
    df = df.withColumn("vo2_support", F.when(c("t_vo2") != "improving", "not leading").when(others, "supported").otherwise("isolated"))
    action = (
        F.when((c("state") == "Improving") & (c("vo2_support") == "supported"), "maintain").when(c("state") == "Declining", "run_easier").when(c("vo2_support") == "isolated", "watch").otherwise("maintain")
    )
    quality = (
        F.when(c("vo2").isNull() & c("cur_pace").isNull(), "poor")
        .when(c("vo20").isNull() | c("base_pace").isNull() | (c("cur_runs") < 2) | (c("base_runs") < 2), "mixed")
        .otherwise("high")
    )
    pace = c("cur_pace") - c("base_pace")
    found = _evidence(
        ("VO2 Max", _signed(c("vo2") - c("vo20"), 1), "text"),
        ("Fixed-HR pace", F.when(pace.isNotNull(), F.concat(F.when(pace > 0, "+").otherwise(""), X.half_up(pace).cast("string"), F.lit(" sec/km"))), "text"),
        ("Power", _signed(c("power") - c("power0"), 1, " W"), "text"),
        ("Resting HR", _signed(c("rhr") - c("rhr0"), 1, " bpm"), "text"),
    )
    return _result(df, state, action, quality, F.when(c("state") == "Unclear", "worth_watching").otherwise("suggests"), found, "score", "vo2_support", *kept)


def aerobic_efficiency(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    return _aerobic_efficiency(_beside(_pace(t, cur=w.current, base=w.baseline), W.z2_ratio_range(t, w.current), _rhr(t, rhr=w.current, rhr0=w.baseline)))


def _aerobic_efficiency(df: DataFrame, *kept: str) -> DataFrame:
    state = X.trend(c("cur_pace"), c("base_pace"), False, 0.02)
    action = _case(c("state"), improving="maintain", declining="run_easier", flat="maintain", other="retest")
    quality = F.when(c("cur_pace").isNull() | c("base_pace").isNull(), "poor").when((c("cur_runs") < 2) | (c("base_runs") < 2), "mixed").otherwise("high")
    pace = c("cur_pace") - c("base_pace")
    found = _evidence(
        ("Fixed-HR pace", F.when(pace.isNotNull(), F.concat(F.when(pace > 0, "+").otherwise(""), X.half_up(pace).cast("string"), F.lit(" sec/km"))), "text"),
        ("Decoupling", F.concat(_fixed(c("cur_decoupling"), 1), F.lit("%")), "text"),
        ("Z2 share", F.concat(X.half_up(c("z2_ratio") * 100).cast("string"), F.lit("%")), "text"),
        ("Resting HR", _signed(c("rhr") - c("rhr0"), 1, " bpm"), "text"),
    )
    claim = F.when(c("state") == "insufficient_data", "worth_watching").otherwise("suggests")
    return _result(df, state, action, quality, claim, found, "cur_pace", "base_pace", "cur_decoupling", "z2_ratio", *kept)


def _runs(t, r: DateRange) -> DataFrame:
    return t.running.filter(X.within("start_ts", r)).agg(F.count("*").alias("runs"), F.avg("duration_sec").alias("avg_duration"))


def load_quality(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    return _load_quality(_beside(_loads(t, load=w.current, chronic=w.chronic28d), W.z2_ratio_range(t, w.current), _runs(t, w.current), _pace(t, pace=False, cur=w.current)))


def _load_quality(df: DataFrame, *kept: str) -> DataFrame:
    df = df.withColumn("load_ratio", X.ratio(c("load"), c("chronic") / 4))
    ratio, z2, dec = c("load_ratio"), c("z2_ratio"), c("cur_decoupling")
    state = (
        F.when(ratio.isNull() | z2.isNull(), "unclear")
        .when((ratio > 1.3) | ((z2 < 0.45) & F.coalesce(dec >= 6, F.lit(False))), "high-strain low-quality")
        .when(z2 < 0.45, "junk intensity")
        .when((z2 >= 0.6) & F.coalesce(dec < 6, F.lit(True)), "productive aerobic")
        .otherwise("mixed")
    )
    action = F.when(c("state") == "productive aerobic", "maintain").when(c("state") == "junk intensity", "run_easier").when(c("state") == "high-strain low-quality", "reduce_intensity").otherwise("watch")
    quality = F.when(ratio.isNull() | z2.isNull() | (c("runs") == 0), "poor").when(dec.isNull() | (c("runs") < 2), "mixed").otherwise("high")
    found = _evidence(
        ("Acute:chronic load", X.fixed_number(_settled(ratio), 2), "num"),
        ("Z2 share", F.concat(X.half_up(z2 * 100).cast("string"), F.lit("%")), "text"),
        ("Decoupling", F.concat(_fixed(dec, 1), F.lit("%")), "text"),
        ("Run consistency", c("runs"), "num"),
    )
    return _result(df, state, action, quality, _suggests(), found, "load_ratio", "z2_ratio", "cur_decoupling", *kept)


def _consistency_inputs(t, **ranges: DateRange) -> DataFrame:
    """Inputs and score for each range, named by its prefix; one scan of each table but that of sleep."""
    inside = {p: X.within("start_ts", r) for p, r in ranges.items()}
    week = t.workouts.agg(
        *[F.count_if(mine).alias(p + "n") for p, mine in inside.items()], *[F.coalesce(F.sum(F.when(mine, c("duration_sec"))) / 60, F.lit(0.0)).alias(p + "minutes") for p, mine in inside.items()]
    )
    nights = [sleep.summary(t, r).select((c("consistency_stddev") / 60).alias(p + "sleep_sd")) for p, r in ranges.items()]
    rhr = daily.resting_hr_daily(t, _covering(ranges))
    deviations = rhr.agg(*_over(rhr, F.stddev_samp, "avg_rhr", **{p + "rhr_sd": r for p, r in ranges.items()}))
    df = _beside(week, _means(daily.steps_daily, t, "total_steps", **{p + "steps": r for p, r in ranges.items()}), *nights, deviations)
    cap = lambda x, top: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * float(top)
    inverse = lambda name, limit, top: F.when(c(name).isNull(), 0.0).otherwise(cap(1 - c(name) / float(limit), top))
    for p in ranges:
        score = cap(c(p + "n") / 3.0, 25) + cap(c(p + "minutes") / 150.0, 25) + cap(F.coalesce(c(p + "steps"), F.lit(0.0)) / 7000.0, 20)
        df = df.withColumn(p + "score", score + inverse(p + "sleep_sd", 45, 15) + inverse(p + "rhr_sd", 3, 15))
    return df


def consistency_index(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    df = _consistency_inputs(t, c_=w.current, b_=w.baseline)
    df = df.withColumn("direction", X.trend(c("c_score"), c("b_score"), True, 0.05))
    state = F.when(c("c_score") >= 75, "strong").when(c("c_score") >= 50, "mixed").otherwise("inconsistent")
    quality = F.when(c("c_steps").isNull() & (c("c_n") == 0), "poor").when(c("b_steps").isNull() & (c("b_n") == 0), "mixed").otherwise("high")
    sleep_text = F.when(c("c_sleep_sd").isNull(), "sleep unknown").otherwise(F.concat(X.half_up(c("c_sleep_sd")).cast("string"), F.lit(" min sleep")))
    rhr_text = F.when(c("c_rhr_sd").isNull(), "RHR unknown").otherwise(F.concat(_fixed(c("c_rhr_sd"), 1), F.lit(" bpm RHR")))
    found = _evidence(
        ("Consistency score", X.half_up(c("c_score")), "num"),
        ("Training rhythm", F.concat(c("c_n").cast("string"), F.lit(" workouts, "), X.half_up(c("c_minutes")).cast("string"), F.lit(" min")), "text"),
        ("Daily basics", X.half_up(c("c_steps")), "num"),
        ("Recovery stability", F.when(c("c_sleep_sd").isNotNull() | c("c_rhr_sd").isNotNull(), F.concat_ws(", ", sleep_text, rhr_text)), "text"),
    )
    return _result(df, state, _case(c("state"), strong="maintain", mixed="watch", other="maintain"), quality, _suggests(), found, "direction", "c_score", "b_score")


def run_economy(t, r: DateRange) -> DataFrame:
    w = composite_windows(r)
    return _run_economy(W.economy_of(t, c_=w.current, b_=w.baseline))


def _run_economy(df: DataFrame, *kept: str) -> DataFrame:
    over = lambda x, limit: F.coalesce(F.greatest(F.lit(0.0), x - limit), F.lit(0.0))
    for p in ("c_", "b_"):
        df = df.withColumn(p + "per_watt", X.ratio(c(p + "avg_speed"), c(p + "avg_power"))).withColumn(p + "per_bpm", X.ratio(c(p + "avg_speed"), c(p + "avg_hr")))
        stride = F.when(c(p + "avg_stride_length_m").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - c(p + "avg_stride_length_m")))
        vertical = F.when(c(p + "avg_vertical_oscillation_cm").isNull(), 0.0).otherwise(over(c(p + "avg_vertical_oscillation_cm"), 10))
        contact = F.when(c(p + "avg_ground_contact_time_ms").isNull(), 0.0).otherwise(over(c(p + "avg_ground_contact_time_ms"), 300))
        df = df.withColumn(p + "penalty", vertical + contact / 20 + stride * 10)
    quality = (
        F.when(c("c_avg_speed").isNull() | c("c_avg_hr").isNull(), "poor")
        .when(c("b_avg_speed").isNull() | c("b_avg_hr").isNull() | c("c_avg_power").isNull() | c("b_avg_power").isNull(), "mixed")
        .otherwise("high")
    )
    watt, bpm = X.trend(c("c_per_watt"), c("b_per_watt")), X.trend(c("c_per_bpm"), c("b_per_bpm"))
    worse = (X.trend(c("c_penalty"), c("b_penalty"), False) == "declining") | (c("c_penalty") - c("b_penalty") >= 1)
    df = df.withColumn("quality", quality).withColumn("t_watt", watt).withColumn("t_bpm", bpm)
    state = (
        F.when(c("quality") == "poor", "insufficient data")
        .when(worse, "mechanics")
        .when((c("t_watt") == "improving") & (c("t_bpm") == "improving"), "fitness")
        .when((c("t_watt") == "declining") & (c("t_bpm") != "improving"), "output")
        .otherwise("mixed economy")
    )
    action = F.when(c("state") == "insufficient data", "retest").when(c("state") == "mechanics", "watch").otherwise("maintain")
    found = _evidence(
        ("Speed per watt", _signed(c("c_per_watt") - c("b_per_watt"), 4), "text"),
        ("Speed per bpm", _signed(c("c_per_bpm") - c("b_per_bpm"), 4), "text"),
        ("Mechanics penalty", X.fixed_number(_settled(c("c_penalty")), 1), "num"),
        ("Output", F.concat(_fixed(c("c_avg_power"), 1), F.lit(" W")), "text"),
    )
    return _result(df, state, action, c("quality"), F.when(c("quality") == "poor", "worth_watching").otherwise("suggests"), found, "c_penalty", "b_penalty", *kept)


def _before(t, runs: DataFrame, series: DataFrame, value: str, name: str) -> DataFrame:
    """Value of the run's day and mean of the seven days before it, for each run."""
    days = runs.select("id", F.to_date("start_ts").alias("run_day"))
    wide = days.withColumn("day", F.explode(F.sequence(F.date_sub("run_day", 7), c("run_day"))))
    own = F.avg(F.when(c("day") == c("run_day"), c(value))).alias(name)
    return wide.join(series, "day").groupBy("id").agg(own, F.avg(F.when(c("day") < c("run_day"), c(value))).alias(name + "0"))


def run_fatigue_flags(t, r: DateRange | None = None) -> DataFrame:
    """One result for each running workout, newest first."""
    runs = t.running.filter(X.within("start_ts", r))
    judged = context.quality_of(t, W.with_sums(t, runs.select("id", "start_ts", "end_ts", "duration_sec")))
    df = (
        judged.select("id", "start_ts", c("sample_quality").alias("quality"), W.drift_columns()[2], W.decoupling_columns()[-1], *W.fade_columns())
        .join(context.context_summary(t, runs).select(c("workout_id").alias("id"), "context_label"), "id")
        .join(_before(t, runs, daily.resting_hr_daily(t), "avg_rhr", "rhr"), "id", "left")
        .join(_before(t, runs, daily.hrv_daily(t), "avg_hrv", "hrv"), "id", "left")
    )
    flagged = (X.trend(c("rhr"), c("rhr0"), False) == "declining") | (X.trend(c("hrv"), c("hrv0")) == "declining")
    over = lambda name, limit: F.coalesce(c(name) >= limit, F.lit(False))
    diagnosis = (
        F.when(c("quality") == "poor", "poor_sample_quality")
        .when(over("drift_pct", 6) | over("decoupling_pct", 6), "cardiac_drift")
        .when(over("speed_fade_pct", 5) | over("power_fade_pct", 5), "pacing_fade")
        .when(flagged, "under_recovered")
        .otherwise("clean_aerobic")
    )
    percent = lambda name: F.concat(_fixed(c(name), 1), F.lit("%"))
    fades = F.concat_ws(", ", F.concat(F.lit("speed "), percent("speed_fade_pct")), F.concat(F.lit("power "), percent("power_fade_pct")))
    named = lambda a, name, unit: F.concat(F.lit(name + " "), F.coalesce(_signed(c(a) - c(a + "0"), 1, unit), F.lit("unknown")))
    before = F.when(c("rhr").isNull() & c("hrv").isNull(), "unknown").otherwise(F.concat_ws(", ", named("rhr", "RHR", " bpm"), named("hrv", "HRV", " ms")))
    found = _evidence(("HR drift", percent("drift_pct"), "text"), ("Decoupling", percent("decoupling_pct"), "text"), ("Pace/power fade", F.when(fades != "", fades), "text"), ("Pre-run recovery", before, "text"))
    df = df.withColumn("diagnosis", diagnosis)
    action = F.when(c("diagnosis") == "clean_aerobic", "maintain").when(c("diagnosis") == "poor_sample_quality", "retest").otherwise("run_easier")
    out = _result(df, c("diagnosis"), action, c("quality"), _suggests(), found, "id", "start_ts", "diagnosis", "drift_pct", "decoupling_pct", "speed_fade_pct", "power_fade_pct", "context_label")
    return out.withColumnRenamed("id", "workout_id").orderBy(F.desc("start_ts"), "workout_id")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, n in weights.items():
        out = F.when(c(column) == name, n).otherwise(out)
    return out


def rank(df: DataFrame) -> DataFrame:
    """Adds the rank by which results are compared."""
    known = F.size(F.filter("evidence", lambda e: e.value_text.isNotNull() | e.value_num.isNotNull()))
    total = _weight("action_kind", ACTIONS) * 100 + _weight("confidence", CONFIDENCE) * 10 + _weight("sample_quality", QUALITY) * 4 + _weight("claim_strength", CLAIMS) + known / F.lit(10.0)
    return df.withColumn("rank", total)


COMMON = ["state", "action_kind", "recommendation", "confidence", "sample_quality", "claim_strength", "evidence"]


def _report_inputs(t, w: Windows) -> DataFrame:
    """What the composites of the report are made from, in one row; samples of workouts are summed once for all of them."""
    of_acute = sleep.summary(t, w.acute7d).select(c("total_hours").alias("total_hours7"))
    return _beside(
        _form(t, w),
        _rhr(t, rhr=w.current, rhr7=w.acute7d, rhr0=w.baseline),
        _hrv(t, hrv=w.current, hrv7=w.acute7d, hrv0=w.baseline),
        _pace(t, cur=w.current, base=w.baseline),
        _loads(t, load=w.current, load0=w.baseline, acute=w.acute7d, chronic=w.chronic28d),
        W.z2_ratio_range(t, w.current),
        _runs(t, w.current),
        W.economy_of(t, c_=w.current, b_=w.baseline),
        sleep.summary(t, w.current),
        of_acute,
    )


def _sections(t, r: DateRange) -> DataFrame:
    """The strongest composite of each of the first three sections; all are columns of one row before they become rows, so that their inputs are computed once."""
    w = composite_windows(r)
    acute = {"rhr": "rhr7", "hrv": "hrv7", "total_hours": "total_hours7"}
    judges = {
        "fitness_trend": ("fitness_direction", 1, _fitness_trend, {}),
        "aerobic_efficiency": ("easy_run_quality", 2, _aerobic_efficiency, {}),
        "load_quality": ("easy_run_quality", 2, _load_quality, {}),
        "run_economy": ("easy_run_quality", 2, _run_economy, {}),
        "readiness": ("recovery_state", 3, lambda df, *kept: _readiness(df, w, *kept), {}),
        "recovery_debt": ("recovery_state", 3, lambda df, *kept: _recovery_debt(df, w, *kept), acute),
        "training_strain": ("recovery_state", 3, _training_strain, acute),
    }
    inputs = _report_inputs(t, w)
    df, kept = inputs.select(F.struct("*").alias("_in")), ["_in"]
    for i, (name, (section, place, judge, other)) in enumerate(judges.items()):
        own = [c("_in")[other.get(x, x)].alias(x) for x in inputs.columns]
        told = [c(x) for x in COMMON] + [F.lit(x).alias(k) for k, x in {"source": name, "_n": i, "section": section, "place": place}.items()]
        df = judge(df.select(*kept, *own), *kept).select(*kept, F.struct(*told).alias(f"_{name}"))
        kept.append(f"_{name}")
    rows = rank(df.select(F.explode(F.array(*kept[1:])).alias("_row")).select("_row.*"))
    best = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("rank"), "_n"))
    return rows.withColumn("_best", best).filter("_best = 1").drop("_best", "_n")


def _workout_section(t, r) -> DataFrame:
    flags = rank(run_fatigue_flags(t, r)).withColumn("severity", _weight("diagnosis", DIAGNOSES))
    # a total order: of flags that are equal otherwise the one of the least workout_id; by diagnosis first, so that flags are computed once
    order = F.struct((-c("severity")).alias("severity"), (-c("rank")).alias("rank"), (-X.epoch("start_ts")).alias("ts"), "workout_id")
    strongest = F.min(F.struct(order.alias("order"), F.struct(*COMMON, "diagnosis", "workout_id").alias("flag")))
    per = flags.groupBy("diagnosis").agg(F.count("*").alias("n"), F.max("start_ts").alias("seen"), strongest.alias("b"))
    df = per.agg(
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("seen", "diagnosis", "n")))), lambda x: F.concat(F.replace(x.diagnosis, F.lit("_"), F.lit(" ")), F.lit(": "), x.n.cast("string"))), ", ").alias("mix"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("b")["flag"].alias("b"),
    )
    item = lambda label, text, num: F.struct(F.lit(label).alias("label"), text.cast("string").alias("value_text"), num.cast("double").alias("value_num"))
    null = F.lit(None)
    full = F.array(item("Strongest flag", F.replace(c("b.diagnosis"), F.lit("_"), F.lit(" ")), null), item("Flagged runs", null, c("n")), item("Flag mix", c("mix"), null), c("b.evidence")[0]).cast(EVIDENCE)
    empty = F.array(item("Flagged runs", null, F.lit(0))).cast(EVIDENCE)
    none = c("n") == 0
    df = df.select(
        F.when(none, "no workout flags").otherwise(c("b.state")).alias("state"),
        F.when(none, "retest").otherwise(c("b.action_kind")).alias("action_kind"),
        F.when(none, ADVICE["retest"]).otherwise(c("b.recommendation")).alias("recommendation"),
        F.when(none, "low").otherwise(c("b.confidence")).alias("confidence"),
        F.when(none, "poor").otherwise(c("b.sample_quality")).alias("sample_quality"),
        F.when(none, "worth_watching").otherwise(c("b.claim_strength")).alias("claim_strength"),
        F.when(none, empty).otherwise(full).alias("evidence"),
        F.lit("run_fatigue_flags").alias("source"),
    )
    return rank(df).withColumn("section", F.lit("workout_diagnoses")).withColumn("place", F.lit(4))


def advanced_report(t, r: DateRange) -> DataFrame:
    """Four sections, and next week's action from the strongest of them."""
    rows = _sections(t, r).unionByName(_workout_section(t, r))
    first = F.first("action_kind").over(Window.partitionBy().orderBy(F.desc("rank"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("next_week_action", first).select("place", "section", "source", *COMMON, "rank", "next_week_action").orderBy("place")
