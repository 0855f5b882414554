"""Run logs, summaries and frame bookkeeping (SRC9-SRC15 parsing, AGG1, AGG2, WIN1, JON1, JON8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.kinematics import gamma, kinetic_energy_ev, speed
from fieldframe.functions.numeric import finite_positive
from fieldframe.operators.blocks import running_sum, shifted_rows


def frame_summary(particles: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Counts, weights and momentum and step ranges per frame (AGG1).

    Sums run over active rows only; a frame without active rows reports zeros. ``dt`` is the
    step of each particle.
    """
    active = F.col("status") == C.STATUS_ACTIVE

    def pick(name: str) -> Column:
        return F.when(active, F.col(name))

    def zero(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(0.0)).alias(name)

    return particles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stored"), F.count(F.when(active, 1)).alias("active"),
        F.count(F.when(~active, 1)).alias("inactive"), zero(F.sum(pick("weight")), "weight_sum"),
        zero(F.min(pick("p")), "p_min"), zero(F.greatest(F.max(pick("p")), F.lit(0.0)), "p_max"),
        zero(F.avg(pick("p")), "p_avg"),
        zero(F.min(pick("dt")), "dt_min"), zero(F.greatest(F.max(pick("dt")), F.lit(0.0)), "dt_max"),
        zero(F.avg(pick("dt")), "dt_avg"),
        F.greatest(F.coalesce(F.max(pick("split_level")), F.lit(0)), F.lit(0)).alias("max_split_level"))


def particle_statistics(particles: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Counts by status, unweighted mean gamma and speed, weighted mean energy (AGG2).

    Needs p, weight, status and the constants rest_mass, speed_of_light, energy_scale_erg.
    """
    mass, c, scale = F.col("rest_mass"), F.col("speed_of_light"), F.col("energy_scale_erg")
    active = F.col("status") == C.STATUS_ACTIVE
    p = F.abs(F.col("p"))
    staged = particles.select(
        *keys, "status", F.when(active, gamma(p, mass, c)).alias("_g"),
        F.when(active, speed(p, mass, c)).alias("_v"),
        F.when(active, kinetic_energy_ev(p, mass, c, scale)).alias("_e"),
        F.when(active & finite_positive(F.col("weight")), F.col("weight")).alias("_w"))

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    out = staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("status") == C.STATUS_ACTIVE, 1)).alias("active"),
        F.count(F.when(F.col("status") == C.STATUS_ESCAPED, 1)).alias("escaped"),
        F.count(F.when(~F.col("status").isin(C.STATUS_ACTIVE, C.STATUS_ESCAPED), 1)).alias("inactive"),
        zero(F.sum("_w")).alias("weight_sum"), zero(F.avg("_g")).alias("mean_gamma"),
        zero(F.max("_g")).alias("max_gamma"), zero(F.avg("_v")).alias("mean_speed"),
        zero(F.max("_v")).alias("max_speed"), zero(F.min("_e")).alias("min_energy_ev"),
        zero(F.max("_e")).alias("max_energy_ev"), zero(F.sum(F.col("_w") * F.col("_e"))).alias("_we"))
    mean = F.when(F.col("weight_sum") > 0.0, F.col("_we") / F.when(F.col("weight_sum") > 0.0, F.col("weight_sum")))
    return out.withColumn("mean_energy_ev", zero(mean)).drop("_we")


def cell_moments(particles: DataFrame, keys: list[str]) -> DataFrame:
    """Count, weight, energy range and weighted pitch-angle moments per cell (AGG27).

    The variance is the weighted mean square minus the squared mean, not below 0.
    """
    w, mu = F.col("weight"), F.col("mu")
    sums = particles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight_sum"),
        F.min("energy_ev").alias("min_energy_ev"), F.max("energy_ev").alias("max_energy_ev"),
        F.sum(w * mu).alias("_m1"), F.sum(w * mu * mu).alias("_m2"))
    total = F.when(F.col("weight_sum") > 0.0, F.col("weight_sum"))
    mean = F.coalesce(F.col("_m1") / total, F.lit(0.0))
    square = F.coalesce(F.col("_m2") / total, F.lit(0.0))
    return sums.select(*keys, "n", "weight_sum", "min_energy_ev", "max_energy_ev", mean.alias("mean_mu"),
                       F.greatest(square - mean * mean, F.lit(0.0)).alias("var_mu"))


def running_elapsed(timing: DataFrame, case: list[str], frame: str = "frame",
                    seconds: str = "frame_seconds", width: int = 1 << 16) -> DataFrame:
    """Elapsed seconds up to each frame of a case (WIN1); (case, frame) is unique."""
    return running_sum(timing, case, [frame], {"elapsed_seconds": seconds}, width=width)


def previous_positions(particles: DataFrame, keys: list[str], order: list[str], columns: list[str],
                       width: int = 1 << 16) -> DataFrame:
    """Previous and step-before positions ``prev_<c>``, ``step_<c>`` (WIN2)."""
    outputs = {f"prev_{c}": (c, 1) for c in columns} | {f"step_{c}": (c, 2) for c in columns}
    return shifted_rows(particles, keys, order, outputs, width=width)


# -- text records ---------------------------------------------------------------------------------

def parse_step_log(lines: DataFrame, keys: list[str], line_no: str = "line_no", text: str = "value") -> DataFrame:
    """Step seconds per frame from log lines; a later line of the same frame wins (SRC11)."""
    hits = lines.filter(F.col(text).rlike(C.STEP_PATTERN)).select(
        *keys, line_no, F.regexp_extract(text, C.STEP_PATTERN, 1).cast("int").alias("frame"),
        F.regexp_extract(text, C.STEP_PATTERN, 2).cast("double").alias("seconds"))
    return hits.groupBy(*keys, "frame").agg(F.max_by("seconds", line_no).alias("frame_seconds"))


def parse_counts(lines: DataFrame, keys: list[str], line_no: str = "line_no", text: str = "value",
                 header_column: str = "iframe") -> DataFrame:
    """Frame and count from whitespace tables (SRC12).

    Line 0 is the header and must name the frame column; a data row with one field fails
    the query.
    """
    fields = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    failed = F.raise_error(F.concat(F.lit("invalid count line: "), F.col(text)))
    is_header, known = F.col(line_no) == 0, F.col(text).contains(header_column)
    frame = F.when(is_header, F.when(known, F.lit(None).cast("int")).otherwise(failed.cast("int"))).otherwise(
        F.when(F.size("_f") >= 2, F.get("_f", F.lit(0)).cast("int")).otherwise(failed.cast("int")))
    count = F.when(~is_header, F.get("_f", F.lit(1)).cast("double"))
    rows = lines.filter(is_header | (F.trim(text) != "")).withColumn("_f", fields)
    data = rows.select(*keys, line_no, frame.alias("frame"), count.alias("_count")).filter(F.col("frame").isNotNull())
    return data.groupBy(*keys, "frame").agg(F.max_by("_count", line_no).alias("particle_count"))


def parse_manifest(lines: DataFrame, keys: list[str], line_no: str = "line_no", text: str = "value") -> DataFrame:
    """key=value lines as (keys, key, value); later lines win, values may contain '=' (SRC13)."""
    pairs = lines.filter(F.col(text).contains("=")).withColumn("_kv", F.split(text, "=", 2))
    return pairs.groupBy(*keys, F.trim(F.get("_kv", F.lit(0))).alias("key")).agg(
        F.max_by(F.trim(F.get("_kv", F.lit(1))), line_no).alias("value"))


def manifest_map(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One map per manifest; its length is the number of distinct names (SRC13)."""
    return pairs.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("manifest"))


# -- frames ---------------------------------------------------------------------------------------------

def frame_number(path: Column, prefix: str = "particles_", digits: int = 5, suffix: str = r"\.bin") -> Column:
    """Frame of a zero-padded file name, NULL for other names (SRC15)."""
    found = F.regexp_extract(path, rf"(?:^|/){prefix}(\d{{{digits}}}){suffix}$", 1)
    return F.when(found != "", found.cast("int"))


def frame_name(frame: Column, prefix: str = "particles_", digits: int = 5, suffix: str = ".bin") -> Column:
    """Zero-padded file name of a frame (SRC15)."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", frame), F.lit(suffix))


def wanted_frames(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """Frames start..end by step (SRC15)."""
    if step <= 0 or end < start:
        raise ValueError("frames need a positive step and end >= start")
    return spark.range(start, end + 1, step).select(F.col("id").cast("int").alias("frame"))


def missing_frames(wanted: DataFrame, available: DataFrame, on: str = "frame") -> DataFrame:
    """Wanted frames that are not available (SET6)."""
    return wanted.select(on).distinct().join(available.select(on).distinct(), on, "left_anti")


def frame_inputs(wanted: DataFrame, field: DataFrame, particles: DataFrame,
                 background: DataFrame | None = None, require_background: bool = False) -> DataFrame:
    """Paths per wanted frame; missing inputs raise with the first 20 names (JON1, SRT5).

    Inputs are path tables (frame, path).
    """
    def paths(df: DataFrame, name: str) -> DataFrame:
        return df.select("frame", F.col("path").alias(name))

    out = wanted.join(paths(field, "field_path"), "frame", "left").join(
        paths(particles, "particle_path"), "frame", "left")
    names = ["field_path", "particle_path"]
    if background is not None:
        out = out.join(paths(background, "background_path"), "frame", "left")
        names += ["background_path"] if require_background else []
    gaps = missing_inputs(out, names)
    preview = [f"{r['input']} of frame {r['frame']}" for r in gaps.orderBy("frame", "input").limit(20).collect()]
    if preview:
        more = gaps.count() - len(preview)
        raise ValueError("missing required inputs: " + ", ".join(preview) + (f" ... {more} more" if more else ""))
    return out


def missing_inputs(inputs: DataFrame, names: list[str]) -> DataFrame:
    """(frame, input) pairs without a path."""
    gaps = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return inputs.select("frame", F.explode(gaps).alias("input"))


def join_counts(steps: DataFrame, counts: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Step times with particle counts; a frame without a count raises (JON8)."""
    if check:
        lonely = steps.join(counts, [*keys, "frame"], "left_anti").limit(1).collect()
        if lonely:
            raise ValueError(f"frame {lonely[0]['frame']} has a step time but no particle count")
    return steps.join(counts, [*keys, "frame"])


def latest_frame(df: DataFrame, keys: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """The highest frame (SRT3)."""
    return df.groupBy(*(keys or [])).agg(F.max(frame).alias(frame))


def union_cases(*tables: DataFrame | None, columns: list[str] | None = None) -> DataFrame:
    """Union of case tables by column name, absent cases skipped (SET1, SNK3, SNK4, SNK6)."""
    present = [t for t in tables if t is not None]
    if not present:
        raise ValueError("no case table is present")
    out = present[0]
    for other in present[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select(*columns) if columns else out


def timing_table(timing: DataFrame, interval_seconds: float) -> DataFrame:
    """Combined timing columns with physical time (SNK4, PRJ41)."""
    return timing.select("case", "frame", (F.col("frame").cast("double") * float(interval_seconds))
                         .alias("physical_time_seconds"), "particle_count", "frame_seconds", "elapsed_seconds")


def run_summary(summary: DataFrame, dt_out: float, timing: DataFrame | None = None) -> DataFrame:
    """The 22 columns of the run summary (SNK1); absent timing columns are 0."""
    out = summary.withColumn("time", F.col("frame").cast("double") * float(dt_out))
    if timing is not None:
        out = out.join(timing, "frame", "left")
    counts = {"injected", "split", "skipped_split_capacity"}
    filled = [F.col(c) if c in out.columns else F.lit(0 if c in counts else 0.0).cast(
        "bigint" if c in counts else "double").alias(c) for c in C.RUN_SUMMARY_COLUMNS]
    return out.select(*filled)


def require_columns(df: DataFrame, names: set[str], what: str = "table") -> DataFrame:
    """Fail before any job when columns are missing (SRC10)."""
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df
