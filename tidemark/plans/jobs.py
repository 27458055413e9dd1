"""The user's jobs: train, predict, tune, and detect (train and predict in one go)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import tuning
from tidemark.operators.clean import clean_series, collapse_duplicates, times_are_unique
from tidemark.operators.ensemble import vote_present
from tidemark.operators.forecast import ForecastParams, fit_forecaster, predict_forecast, residuals
from tidemark.operators.iforest import TREES, fit_iforest, predict_iforest
from tidemark.operators.residual_score import ROUNDS, beta_score, student_t_score, label_two_tail
from tidemark.operators.series import ROWS_PER_CHUNK, ROWS_PER_GROUP, HotSeries, hot_series
from tidemark.operators.splits import split, split_date, with_lookback
from tidemark.operators.timeparts import accepted_parts, apply_time_parts, select_time_parts
from tidemark.operators.trend import TrendParams, fit_trend, label_band, trend_band
from tidemark.session import materialize
from tidemark.sources.readers import coerce_feature, coerce_time, since
from tidemark.sources.store import (
    load_metadata, load_models, run_metadata, save_metadata, save_models, table_exists, write_results)
from tidemark.spec import SeriesSpec

ROW = "_row"
LABELS = [*[f"ad_label_{i}" for i in (1, 2, 3)], "predicted_label"]
# Columns that the jobs add to the raw rows; raw columns of these names are replaced.
ADDED = ["predict", "residuals", *[f"anomaly_score_{i}" for i in (1, 2, 3)], *LABELS]
# Null features are filled from so many earlier rows.
FILL_ROWS = 3


@dataclass(frozen=True)
class JobSettings:
    forecast: ForecastParams = field(default_factory=ForecastParams)
    trend: TrendParams = field(default_factory=lambda: TrendParams(kind="piecewise"))
    contamination: float = 0.01
    trees: int = TREES
    forest_mode: str = "exact"
    # "train": fit before the split date; "window": refit on the scored rows.
    forest_fit_on: str = "train"
    rounds: int = ROUNDS
    score_method: str = "beta"
    period: str | None = None
    split_ratio: float = 0.8
    time_parts: bool = True
    compat: bool = True
    collapse: bool = False
    # Whether training first tunes the series that have no parameters, on half of the combinations.
    tune_first: bool = False
    seed: int = 42


def ingest(df: DataFrame, spec: SeriesSpec, settings: JobSettings) -> tuple[DataFrame, SeriesSpec]:
    """Raw rows with typed time and feature; the mean per time where times repeat and that is wanted.

    Groups, time and ``tie`` must identify a row, as results are joined back on them. Where they do not (the key columns are counted once), or
    the columns of ``tie`` are not all there, and rows are not collapsed, the rows are written once with a number.
    """
    out = coerce_feature(coerce_time(df, spec.time), spec.feature).drop(*ADDED, ROW)
    if settings.collapse and not times_are_unique(out, spec):
        out = collapse_duplicates(out, spec)
    if not spec.tie or not set(spec.tie) <= set(out.columns):
        spec = replace(spec, tie=())
        if not settings.collapse:
            out = materialize(out.withColumn(ROW, F.monotonically_increasing_id()), "raw")
    elif not settings.collapse and not _identified(out, spec):
        out = materialize(out.withColumn(ROW, F.monotonically_increasing_id()), "raw")
        spec = replace(spec, tie=(*spec.tie, ROW))
    return out, spec


def _identified(rows: DataFrame, spec: SeriesSpec) -> bool:
    """Whether no two rows agree in groups, time and tie."""
    keys = list(dict.fromkeys([*spec.groups, *spec.order]))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def _keys(raw: DataFrame, spec: SeriesSpec) -> list[str]:
    return [ROW] if ROW in raw.columns else list(dict.fromkeys([*spec.groups, *spec.order]))


def with_results(raw: DataFrame, scored: DataFrame, spec: SeriesSpec, date: datetime) -> DataFrame:
    """All raw rows from ``date`` on with all their columns, and what was found for them.

    Rows that no detector scored (sparse series, null groups, series without a model) get
    labels 0 and NULL scores. Raw values stay as they were, nulls included.
    """
    keys = _keys(raw, spec)
    added = [c for c in scored.columns if c not in raw.columns]
    out = since(raw, spec.time, date).join(scored.select(*keys, *added), keys, "left")
    return out.fillna(0, subset=LABELS).drop(ROW)


def prepare(raw: DataFrame, spec: SeriesSpec, settings: JobSettings, parts: list[str] | None = None,
            sparse: float = 0.5) -> tuple[DataFrame, SeriesSpec, list[str]]:
    """Cleaned rows with the time parts as further groups, written once.

    ``parts`` are those of an earlier run; None decides them from the data. Series with a share of
    ``sparse`` null features or more are left out, and so are rows without a time.
    """
    columns = list(dict.fromkeys([*spec.groups, *spec.order, spec.feature, *_keys(raw, spec)]))
    rows = raw.select(*columns).where(F.col(spec.time).isNotNull())
    frame = materialize(clean_series(rows, spec, sparse, FILL_ROWS), "prepared")
    if parts is None:
        parts = []
        if settings.time_parts:
            parts = accepted_parts(select_time_parts(frame, _drawable(spec), settings.seed, settings.compat))
    frame, with_parts = apply_time_parts(frame, spec, parts)
    return frame, _drawable(with_parts), parts


def _drawable(spec: SeriesSpec) -> SeriesSpec:
    """Rows are drawn by a hash of their identifier; without one, of their time."""
    return spec if spec.tie else replace(spec, tie=(spec.time,))


@dataclass(frozen=True)
class Facts:
    """What the jobs need to know about a prepared frame, from one aggregation."""

    first: datetime | None
    last: datetime | None
    normalized: bool
    hot: HotSeries


def look(frame: DataFrame, spec: SeriesSpec) -> Facts:
    t, y = spec.time, spec.feature
    per_series = frame.groupBy(*spec.groups).agg(
        F.count(F.lit(1)).alias("rows"), F.min(t).alias("first"), F.max(t).alias("last"),
        F.min(y).alias("low"), F.max(y).alias("high"))
    row = per_series.agg(F.max("rows").alias("rows"), F.min("first").alias("first"),
                         F.max("last").alias("last"), F.min("low").alias("low"),
                         F.max("high").alias("high")).first()
    hot = HotSeries(spec, ROWS_PER_GROUP, None)
    if (row["rows"] or 0) > ROWS_PER_GROUP:
        hot = hot_series(frame, spec, ROWS_PER_GROUP)
    low, high = row["low"], row["high"]
    normalized = low is not None and 0 <= low < 1 and 0 < high <= 1
    return Facts(row["first"], row["last"], normalized, hot)


def fit_models(frame: DataFrame, spec: SeriesSpec, date: datetime, settings: JobSettings,
               facts: Facts, params: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Model tables of the three detectors. The trend sees the whole history, the
    other two the rows before the split date. ``params`` has tables of tuned parameters by detector;
    series that are not in them have those of the settings."""
    own = (params or {}).get
    past, _ = split(frame, spec.time, date)
    windows = facts.hot.above(ROWS_PER_CHUNK)
    return {
        "lstm": fit_forecaster(past, spec, settings.forecast, facts.normalized, windows, own("lstm")),
        "iso_f": fit_iforest(past, spec, settings.contamination, settings.trees,
                             settings.forest_mode, settings.seed, facts.hot, params=own("iso_f")),
        "prophet": fit_trend(frame, spec, settings.trend, windows, own("prophet")),
    }


def score(frame: DataFrame, spec: SeriesSpec, models: dict[str, DataFrame], date: datetime,
          settings: JobSettings, facts: Facts) -> DataFrame:
    """Rows from ``date`` on with the three detectors' columns and the vote.

    All detectors add columns to the same rows, so no join between their outputs
    is needed.
    """
    p = settings.forecast
    rows = with_lookback(frame, spec, date, p.reach + p.warmup)
    rows = predict_forecast(rows, models["lstm"], spec, p, hot=facts.hot.above(ROWS_PER_CHUNK))
    rows = rows.where(F.col("warmup") == 0).drop("warmup")
    # The score takes several looks at these rows.
    rows = materialize(rows, "forecast")
    known = rows.where(F.col("predict").isNotNull())
    known = known.withColumn("residuals", residuals(F.col(spec.feature), F.col("predict")))
    if settings.score_method == "student_t":
        scored = student_t_score(known, spec).drop("t_value")
        scored = scored.withColumn("ad_label_1", label_two_tail(F.col("anomaly_score_1")))
    else:
        scored = beta_score(known, spec, rounds=settings.rounds, seed=settings.seed)
    out = scored.unionByName(rows.where(F.col("predict").isNull()), allowMissingColumns=True)
    forest = models["iso_f"]
    if settings.forest_fit_on == "window":
        forest = fit_iforest(rows, spec, settings.contamination, settings.trees,
                             settings.forest_mode, settings.seed, facts.hot)
    out = predict_iforest(out, forest, spec, facts.hot)
    out = trend_band(out, models["prophet"], spec, settings.trend.interval_width)
    out = label_band(out, spec).drop("yhat", "yhat_lower", "yhat_upper")
    return vote_present(out.fillna(0, subset=LABELS[:3]))


def _split_date(facts: Facts, spark, settings: JobSettings) -> datetime:
    ends = spark.createDataFrame([(facts.first, facts.last)], "low timestamp, high timestamp")
    return split_date(ends, None, settings.period, settings.split_ratio)


def detect(df: DataFrame, spec: SeriesSpec, settings: JobSettings = JobSettings()) -> DataFrame:
    """Train and predict in memory: all raw rows after the split date with labels and scores."""
    raw, user = ingest(df, spec, settings)
    frame, spec, _ = prepare(raw, user, settings)
    facts = look(frame, spec)
    if facts.first is None:
        raise ValueError("no series has enough known values to train on")
    date = _split_date(facts, df.sparkSession, settings)
    models = fit_models(frame, spec, date, settings, facts)
    return with_results(raw, score(frame, spec, models, date, settings, facts), user, date)


def _first_needed(frame: DataFrame, spec: SeriesSpec, date: datetime, settings: JobSettings) -> datetime:
    """First time that predictions from ``date`` on look back to, over the series that go on after it."""
    reach = settings.forecast.reach + settings.forecast.warmup + FILL_ROWS
    rows = with_lookback(frame.select(*spec.groups, *spec.order), spec, date, reach)
    if spec.groups:
        rows = rows.join(rows.where("warmup = 0").select(*spec.groups).distinct(), list(spec.groups), "left_semi")
    return rows.agg(F.min(spec.time)).first()[0] or date


def train(df: DataFrame, spec: SeriesSpec, path: str, settings: JobSettings = JobSettings()) -> list[str]:
    """Fit the detectors and save models and run metadata under ``path``.

    Each series is fitted with its own tuned parameters under ``path``. With ``settings.tune_first``, series that
    have none are tuned ahead; without it they get those of the settings.
    """
    raw, spec = ingest(df, spec, settings)
    frame, spec, parts = prepare(raw, spec, settings)
    facts = look(frame, spec)
    if facts.first is None:
        raise ValueError("no series has enough known values to train on")
    date = _split_date(facts, df.sparkSession, settings)
    params = {}
    for detector in tuning.DEFAULTS:
        if settings.tune_first:
            _tune(frame, spec, detector, path, None, True, settings.seed)
        known = tuned_params(df.sparkSession, spec, detector, path)
        if known is not None:
            params[detector] = known
    for name, rows in fit_models(frame, spec, date, settings, facts, params).items():
        save_models(rows, f"{path}/models", name)
    dates = {"split_date": date, "read_from": _first_needed(frame, spec, date, settings)}
    meta = run_metadata(frame, spec.time, parts).withColumns({
        k: F.date_format(F.lit(v), "yyyy-MM-dd HH:mm:ss.SSSSSS") for k, v in dates.items()})
    save_metadata(meta, f"{path}/metadata")
    return parts


def predict(df: DataFrame, spec: SeriesSpec, path: str, settings: JobSettings = JobSettings(),
            run_date: str | None = None) -> DataFrame:
    """All rows from the training's split date on, scored with the saved models; with ``run_date``
    also written as that day's results.

    Only rows from the saved ``read_from`` on are read: those, and what they look back to. A
    null that has no known value shortly before it is filled with the mean of the rows read. Each detector
    labels the series it has a model of.
    """
    spark = df.sparkSession
    meta = load_metadata(spark, f"{path}/metadata")
    saved = [p for p in meta["time_groups"].split("*") if p]
    date, first = meta["split_date"], meta["read_from"]
    recent = df
    if df.schema[spec.time].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        # On the column as it is, so that the source can skip what is older.
        recent = since(df, spec.time, first)
    raw, user = ingest(recent, spec, settings)
    raw = since(raw, spec.time, first)
    # Series too sparse to be trained on have no model; here no series is left out.
    frame, spec, _ = prepare(raw, user, settings, saved, sparse=2.0)
    models = {m: load_models(spark, f"{path}/models", m) for m in ("lstm", "iso_f", "prophet")}
    facts = look(frame, spec)
    out = with_results(raw, score(frame, spec, models, date, settings, facts), user, date)
    if run_date:
        write_results(out, f"{path}/results", run_date)
        out = spark.read.parquet(f"{path}/results").where(F.col("run_date") == run_date)
    return out


def tune(df: DataFrame, spec: SeriesSpec, detector: str, path: str | None = None,
         ranges: dict | None = None, implicit: bool = False,
         settings: JobSettings = JobSettings(), parts: list[str] | None = None) -> DataFrame:
    """Best parameters per series of one detector (``lstm``, ``iso_f``, ``prophet``).

    ``implicit`` tries a random half of the grid, as the first training does.
    Series that already have parameters under ``path`` are left as they are, and all are returned.
    The series are those of the training saved under ``path``, else of ``parts``.
    """
    spark = df.sparkSession
    params = f"{path}/params"
    raw, spec = ingest(df, spec, settings)
    if parts is None:
        parts = []
        if path and table_exists(spark, f"{path}/metadata"):
            parts = [p for p in load_metadata(spark, f"{path}/metadata")["time_groups"].split("*") if p]
    frame, spec, _ = prepare(raw, spec, settings, parts)
    return _tune(frame, spec, detector, path, ranges, implicit, settings.seed)


def tuned_params(spark, spec: SeriesSpec, detector: str, path: str | None) -> DataFrame | None:
    """The parameters saved under ``path``; None where there are none, or they are of series with other groups."""
    if not path or not table_exists(spark, f"{path}/params/model={detector}"):
        return None
    table = load_models(spark, f"{path}/params", detector)
    parameters = {*tuning.DEFAULTS[detector], "combo_id", "error", "model"}
    return table if set(table.columns) - parameters == set(spec.groups) else None


def _tune(frame: DataFrame, spec: SeriesSpec, detector: str, path: str | None, ranges: dict | None,
          implicit: bool, seed: int) -> DataFrame:
    """:func:`tune` on a prepared frame."""
    spark, params = frame.sparkSession, f"{path}/params"
    old = tuned_params(spark, spec, detector, path)
    if old is not None:
        frame = materialize(tuning.tune_if_needed(frame, old.select(*spec.groups), spec.groups), "untuned")
        if frame.isEmpty():
            return old
    grid = tuning.param_grid(spark, tuning.DEFAULTS[detector], ranges or tuning.RANGES[detector])
    grid = materialize(tuning.half_grid(grid, seed) if implicit else grid, "grid")
    tail = frame
    if tuning.TAIL_SHARE[detector] < 1:
        tail = tuning.tail_window(frame, spec, tuning.TAIL_SHARE[detector])
    objective = {"lstm": tuning.objective_rolling, "iso_f": tuning.objective_iforest,
                 "prophet": tuning.objective_trend}[detector]
    errors = materialize(objective(tail, spec, grid), "errors")
    best = tuning.best_params(errors, grid, spec.groups)
    if not path:
        return best
    if old is not None:
        # Written elsewhere first: the table that is replaced is read here.
        best = materialize(old.unionByName(best.select(*old.columns)), "params")
    save_models(best, params, detector)
    return load_models(spark, params, detector)
