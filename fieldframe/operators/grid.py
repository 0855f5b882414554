"""Grid stencils, ghosts, resampling and block stitching (GRD1-GRD9, SRC6-SRC8, WIN4, WIN5).

Fields are long tables with one row per cell and integer indices ``ix``, ``iy`` (``iz``).
A stencil window is partitioned by one grid line, so a task holds lines, never frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.axes import Axis
from fieldframe.functions.geometry import lame, jacobian
from fieldframe.functions.numeric import finite, finite_positive
from fieldframe.session import materialize

DIMS = ("ix", "iy", "iz")


def _line(keys: list[str], axes: dict[str, Axis], dim: str) -> list[str]:
    return [*keys, *[d for d in axes if d != dim]]


def neighbours(field: DataFrame, axes: dict[str, Axis], dim: str, columns: list[str],
               keys: list[str]) -> DataFrame:
    """Add ``<c>_lo`` and ``<c>_hi``: the values one cell down and up a grid line (WIN4, GRD2).

    At the ends a periodic axis wraps and any other axis repeats the border value.
    """
    group = W.partitionBy(*_line(keys, axes, dim))
    ordered = group.orderBy(dim)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    added = {}
    for c in columns:
        first = F.first(c).over(whole) if axes[dim].periodic else F.col(c)
        last = F.last(c).over(whole) if axes[dim].periodic else F.col(c)
        position = F.col(dim)
        # lag/lead miss only at the two ends of a dense line
        added[f"{c}_{dim}_lo"] = F.when(position == 0, last).otherwise(F.lag(c).over(ordered))
        added[f"{c}_{dim}_hi"] = F.when(position == axes[dim].n - 1, first).otherwise(
            F.lead(c).over(ordered))
    return field.withColumns(added)


def three_point(xl: Column, xc: Column, xr: Column, vl: Column, vc: Column, vr: Column) -> Column:
    """Centred derivative on unequal spacing (GRD1): the slope of the parabola at the centre.

    Written as the mean of the one-sided slopes weighted by the opposite widths.
    """
    a, b = xc - xl, xr - xc
    left, right = (vc - vl) / a, (vr - vc) / b
    return (left * b + right * a) / (a + b)


def _q(axes: dict[str, Axis], moved: str | None = None, offset: int = 0) -> list[Column]:
    return [a.center(F.col(d) + offset) if d == moved else a.center(F.col(d)) for d, a in axes.items()]


def _positions(axes: dict[str, Axis], dim: str) -> tuple[Column, Column, Column]:
    axis, i = axes[dim], F.col(dim)
    return axis.center(i - 1), axis.center(i), axis.center(i + 1)


def gradient(field: DataFrame, axes: dict[str, Axis], value: str, keys: list[str],
             system: str = "cartesian") -> DataFrame:
    """Physical gradient components ``grad_1..`` of a scalar (GRD3)."""
    out = field
    for dim in axes:
        out = neighbours(out, axes, dim, [value], keys)
    scale = lame(system, _q(axes))
    parts = {}
    for k, dim in enumerate(axes):
        xl, xc, xr = _positions(axes, dim)
        slope = three_point(xl, xc, xr, F.col(f"{value}_{dim}_lo"), F.col(value),
                            F.col(f"{value}_{dim}_hi"))
        parts[f"grad_{k + 1}"] = slope / scale[k]
    return out.withColumns(parts).select(*field.columns, *parts)


def divergence(field: DataFrame, axes: dict[str, Axis], components: list[str], keys: list[str],
               system: str = "cartesian") -> DataFrame:
    """Divergence of a vector field in an orthogonal basis (GRD4)."""
    out = field
    for k, dim in enumerate(axes):
        out = neighbours(out, axes, dim, [components[k]], keys)
    dims = len(axes)
    total = F.lit(0.0)
    for k, dim in enumerate(axes):
        c = components[k]

        def weighted(value: Column, offset: int, k: int = k, dim: str = dim) -> Column:
            q = _q(axes, dim, offset)
            return value * jacobian(system, q, dims) / lame(system, q)[k]

        xl, xc, xr = _positions(axes, dim)
        total = total + three_point(xl, xc, xr, weighted(F.col(f"{c}_{dim}_lo"), -1),
                                    weighted(F.col(c), 0), weighted(F.col(f"{c}_{dim}_hi"), 1))
    return out.withColumn("divergence", total / jacobian(system, _q(axes), dims)).select(
        *field.columns, "divergence")


def curl(field: DataFrame, axes: dict[str, Axis], components: list[str], keys: list[str],
         system: str = "cartesian") -> DataFrame:
    """Curl components ``curl_1..curl_3``; derivatives along absent axes are 0 (GRD5)."""
    dims = list(axes)
    needed: dict[str, list[str]] = {}
    for target in range(3):
        for along, comp in (((target + 1) % 3, (target + 2) % 3), ((target + 2) % 3, (target + 1) % 3)):
            if along < len(dims) and components[comp] not in needed.setdefault(dims[along], []):
                needed[dims[along]].append(components[comp])
    out = field
    for dim, columns in needed.items():
        out = neighbours(out, axes, dim, columns, keys)

    def pad(q: list[Column]) -> list[Column]:
        return q + [F.lit(0.0)] * (3 - len(q))

    def derivative(along: int, comp: int) -> Column:
        if along >= len(dims):
            return F.lit(0.0)
        dim, c = dims[along], components[comp]
        h = [lame(system, pad(_q(axes, dim, o)))[comp] for o in (-1, 0, 1)]
        xl, xc, xr = _positions(axes, dim)
        return three_point(xl, xc, xr, F.col(f"{c}_{dim}_lo") * h[0], F.col(c) * h[1],
                           F.col(f"{c}_{dim}_hi") * h[2])

    here = lame(system, pad(_q(axes)))
    parts = {}
    for target in range(3):
        a, b = (target + 1) % 3, (target + 2) % 3
        parts[f"curl_{target + 1}"] = (derivative(a, b) - derivative(b, a)) / (here[a] * here[b])
    return out.withColumns(parts).select(*field.columns, *parts)


def one_sided_derivative(value: str, x: str, keys: list[str], dim: str) -> Column:
    """Second-order derivative along a line, one-sided at both ends (GRD6).

    The inside uses the unequal-spacing centre formula, the ends the parabola through
    the three border points.
    """
    w = W.partitionBy(*keys).orderBy(dim)
    v, q = F.col(value), F.col(x)
    vl, vr, ql, qr = (F.lag(value).over(w), F.lead(value).over(w), F.lag(x).over(w), F.lead(x).over(w))
    inside = three_point(ql, q, qr, vl, v, vr)

    def border(step: int) -> Column:
        shift = F.lead if step > 0 else F.lag
        v1, v2 = shift(value, 1).over(w), shift(value, 2).over(w)
        q1, q2 = shift(x, 1).over(w), shift(x, 2).over(w)
        near, far = (v1 - v) / (q1 - q), (v2 - v1) / (q2 - q1)
        return near + (near - far) * (q1 - q) / (q2 - q)

    return F.when(vl.isNull(), border(1)).when(vr.isNull(), border(-1)).otherwise(inside)


def current_proxy(field: DataFrame, keys: list[str], bx: str = "bx", by: str = "by",
                  x: str = "x", y: str = "y") -> DataFrame:
    """Out-of-plane current d(by)/dx - d(bx)/dy (GRD6)."""
    return (field
            .withColumn("_dby", one_sided_derivative(by, x, [*keys, "iy"], "ix"))
            .withColumn("_dbx", one_sided_derivative(bx, y, [*keys, "ix"], "iy"))
            .withColumn("jz", F.col("_dby") - F.col("_dbx")).drop("_dby", "_dbx"))


def gradient_table(field: DataFrame, axes: dict[str, Axis], keys: list[str],
                   full: bool = False) -> DataFrame:
    """Field values, |B| and first derivatives per cell (GRD7).

    The narrow form has 16 value columns, the ``full`` form 21 (also vz and all velocity
    derivatives). Plain two-point centred differences; one exchange per axis serves every
    column of that axis.
    """
    bmag = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    out = field.withColumn("bmag", bmag)
    fields_x = ["vx", "vy", "vz", "bx", "by", "bz", "bmag"] if full else ["vx", "bx", "by", "bz", "bmag"]
    fields_y = ["vx", "vy", "vz", "bx", "by", "bz", "bmag"] if full else ["vy", "bx", "by", "bz", "bmag"]
    out = neighbours(out, axes, "ix", fields_x, keys)
    out = neighbours(out, axes, "iy", fields_y, keys)
    parts = {}
    for dim, names in (("ix", fields_x), ("iy", fields_y)):
        xl, _, xr = _positions(axes, dim)
        for c in names:
            parts[f"d{c}_d{dim[1]}"] = (F.col(f"{c}_{dim}_hi") - F.col(f"{c}_{dim}_lo")) / (xr - xl)
    values = (["vx", "vy", "vz"] if full else ["vx", "vy"]) + ["bx", "by", "bz", "bmag"]
    order = [f"d{c}_d{d}" for c in fields_x + [f for f in fields_y if f not in fields_x]
             for d in "xy" if f"d{c}_d{d}" in parts]
    return out.withColumns(parts).select(*keys, *axes, *values, *order)


def add_ghosts(field: DataFrame, axes: dict[str, Axis], ghosts: int = 1,
               mode: str = "periodic_or_clamped") -> DataFrame:
    """Add ghost rows around the domain, corners included (GRD2, SNK12).

    Each border row emits its copies itself, so no shuffle is needed. ``periodic_only``
    leaves non-periodic sides without ghosts.
    """
    out = field
    for dim, axis in axes.items():
        i, n = F.col(dim), axis.n
        if axis.periodic:
            targets = F.array_compact(F.array(
                i, F.when(i < ghosts, i + n), F.when(i >= n - ghosts, i - n)))
        elif mode == "periodic_only":
            continue
        else:
            below = F.sequence(F.lit(-ghosts), F.lit(-1))
            above = F.sequence(F.lit(n), F.lit(n + ghosts - 1))
            none = F.array().cast("array<int>")
            targets = F.concat(F.array(i), F.when(i == 0, below).otherwise(none),
                               F.when(i == n - 1, above).otherwise(none))
        out = out.withColumn(dim, F.explode(targets))
    return out


def close_periodic_faces(field: DataFrame, axes: dict[str, Axis], columns: list[str],
                         keys: list[str]) -> DataFrame:
    """Copy the lower face of periodic axes onto the redundant upper face (GRD2).

    Face indices run 0..n.
    """
    out = field
    for dim, axis in axes.items():
        if not axis.periodic:
            continue
        w = (W.partitionBy(*_line(keys, axes, dim)).orderBy(dim)
             .rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        out = out.withColumns({c: F.when(F.col(dim) == axis.n, F.first(c).over(w)).otherwise(F.col(c))
                               for c in columns})
    return out


# -- sampling and resampling -------------------------------------------------------------

def corner_table(field: DataFrame, axes: dict[str, Axis], columns: list[str],
                 keys: list[str]) -> DataFrame:
    """One row per lower cell with the values at the 2^d corners of its stencil.

    Column ``<c>_<bits>`` is the value at (i + bit) along each axis, in axis order. The
    top cell repeats itself (clamped stencil). Building this on the grid side lets a
    sampler join each point once instead of once per corner.
    """
    out = field.withColumnsRenamed({c: f"{c}_" for c in columns})
    suffixes = [""]
    for dim in axes:
        w = W.partitionBy(*_line(keys, axes, dim)).orderBy(dim)
        added = {}
        for c in columns:
            for s in suffixes:
                low = F.col(f"{c}_{s}")
                added[f"{c}_{s}1"] = F.coalesce(F.lead(f"{c}_{s}").over(w), low)
                added[f"{c}_{s}0"] = low
        names = [*keys, *axes] + list(added)
        out = out.withColumns(added).select(*names)
        suffixes = [s + b for s in suffixes for b in "01"]
    return out


def _blend(column: str, weights: list[Column]) -> Column:
    """Multilinear combination of the corner columns."""
    total = F.lit(0.0)
    for corner in range(1 << len(weights)):
        bits = [(corner >> k) & 1 for k in range(len(weights))]
        share = F.lit(1.0)
        for bit, w in zip(bits, weights):
            share = share * (w if bit else 1.0 - w)
        total = total + share * F.col(f"{column}_{''.join(map(str, bits))}")
    return total


def multilinear_sample(points: DataFrame, field: DataFrame, axes: dict[str, Axis],
                       coordinates: dict[str, str], columns: list[str], keys: list[str],
                       boundary: str = "wrap", shift: float = 0.0, stage: bool = False) -> DataFrame:
    """Sample field columns at point positions (JON4).

    ``boundary`` is ``inside`` (points outside are dropped), ``wrap`` (periodic axes wrap,
    others must be inside) or ``clamp``. ``shift`` moves the position by that many cells.
    One equi-join on (keys, lower cell) per point; results are ``s_<column>``. With ``stage``
    the corner table is written first: Catalyst then knows its size and does not shuffle the
    points when it can be broadcast.
    """
    staged, usable = {}, F.lit(True)
    for dim, axis in axes.items():
        x = F.col(coordinates[dim])
        if boundary in ("wrap", "clamp") and axis.periodic:
            x = axis.wrap(x)
        if boundary == "clamp":
            x = F.greatest(F.least(x, F.lit(max(axis.lower, axis.upper))),
                           F.lit(min(axis.lower, axis.upper)))
        else:
            usable = usable & axis.contains(x)
        logical = axis.center_index(x) + shift
        bounded = F.greatest(F.least(logical, F.lit(float(axis.n - 1))), F.lit(0.0))
        staged[f"_t_{dim}"] = bounded
    placed = points.filter(usable).withColumns(staged)
    placed = placed.withColumns({dim: F.floor(f"_t_{dim}").cast("int") for dim in axes})
    corners = corner_table(field, axes, columns, keys)
    if stage:
        corners = materialize(corners, "corners")
    joined = placed.join(corners, [*keys, *axes])
    weights = [F.col(f"_t_{d}") - F.col(d) for d in axes]
    samples = [_blend(c, weights).alias(f"s_{c}") for c in columns]
    return joined.select(*points.columns, *samples)


def bilinear_resample(field: DataFrame, raw: dict[str, Axis], target: dict[str, Axis],
                      columns: list[str], keys: list[str]) -> DataFrame:
    """Resample cell values to the centres of another grid, extrapolating at the rim (GRD9)."""
    grid = field.select(*keys).distinct()
    for dim, axis in target.items():
        grid = grid.withColumn(f"t_{dim}", F.explode(F.sequence(F.lit(0), F.lit(axis.n - 1))))
    placed = grid.withColumns({
        f"_g_{d}": raw[d].center_index(a.center(F.col(f"t_{d}"))) for d, a in target.items()})
    placed = placed.withColumns({
        d: F.greatest(F.least(F.floor(f"_g_{d}"), F.lit(raw[d].n - 2)), F.lit(0)).cast("int")
        for d in target})
    joined = placed.join(corner_table(field, raw, columns, keys), [*keys, *raw])
    weights = [F.col(f"_g_{d}") - F.col(d) for d in raw]
    return joined.select(*keys, *[F.col(f"t_{d}").alias(d) for d in target],
                         *[_blend(c, weights).alias(c) for c in columns])


# -- time --------------------------------------------------------------------------------

def time_pairs(field: DataFrame, columns: list[str], cell: list[str], time: str = "t",
               frame: str = "frame") -> DataFrame:
    """Each cell row with the values of the next frame, ``<c>_next`` (JON5)."""
    w = W.partitionBy(*cell).orderBy(frame)
    return field.withColumns({f"{c}_next": F.lead(c).over(w) for c in [*columns, time]})


def time_derivative(field: DataFrame, columns: list[str], cell: list[str], time: str = "t",
                    frame: str = "frame") -> DataFrame:
    """Forward difference between adjacent frames, ``d<c>_dt`` (WIN5); the last frame has no row."""
    pairs = time_pairs(field, columns, cell, time, frame).filter(F.col(f"{time}_next").isNotNull())
    dt = F.col(f"{time}_next") - F.col(time)
    return pairs.select(frame, *cell, *[((F.col(f"{c}_next") - F.col(c)) / dt).alias(f"d{c}_dt")
                                        for c in columns])


#: Tolerance of the bracket test: 64 machine epsilons.
BRACKET_TOLERANCE = 64.0 * 2.0 ** -52


def time_interpolate(field: DataFrame, columns: list[str], cell: list[str], target: Column,
                     time: str = "t", frame: str = "frame", bounds: str = "bracketed") -> DataFrame:
    """Linear interpolation between each frame and the next (GRD8).

    ``bounds``: ``bracketed`` fails the query when the weight leaves [0, 1], ``clamped``
    clips it (sampler rule), ``extrapolate`` takes it as it is.
    """
    pairs = time_pairs(field, columns, cell, time, frame).filter(F.col(f"{time}_next").isNotNull())
    w = (target - F.col(time)) / (F.col(f"{time}_next") - F.col(time))
    if bounds == "clamped":
        w = F.greatest(F.least(w, F.lit(1.0)), F.lit(0.0))
    elif bounds == "bracketed":
        inside = (w >= -BRACKET_TOLERANCE) & (w <= 1.0 + BRACKET_TOLERANCE)
        w = F.when(inside, w).otherwise(F.raise_error(F.lit("target time outside the frame pair")).cast("double"))
    staged = pairs.withColumn("_w", w)
    return staged.select(frame, *cell, *[
        ((1.0 - F.col("_w")) * F.col(c) + F.col("_w") * F.col(f"{c}_next")).alias(c) for c in columns])


# -- block-structured input ----------------------------------------------------------------

def stitch_blocks(blocks: DataFrame, nxb: int, nyb: int, variables: list[str],
                  keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Assemble (block location, local index, variable) rows into one field (SRC6).

    Input columns: keys, li, lj (block location), i, j (local), var, value.
    """
    placed = blocks.withColumns({"ix": F.col("li") * nxb + F.col("i"),
                                 "iy": F.col("lj") * nyb + F.col("j")})
    return (placed.groupBy(*keys, "iy", "ix")
            .agg(*[F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables]))


def resolve_aliases(df: DataFrame, wanted: dict[str, tuple[str, ...]] | None = None,
                    required: tuple[str, ...] = ("bx", "by", "bz", "vx", "vy", "vz")) -> DataFrame:
    """Rename the first alias present to the standard name (SRC7).

    A required variable without any alias is an error; an optional one is left out.
    """
    chosen = []
    for name, aliases in (wanted or C.FIELD_ALIASES).items():
        found = next((a for a in (name, *aliases) if a in df.columns), None)
        if found is None and name in required:
            raise ValueError(f"none of {list(aliases)} found for {name}; columns are {df.columns}")
        if found is not None:
            chosen.append(F.col(f"`{found}`").alias(name))
    used = {a for aliases in (wanted or C.FIELD_ALIASES).values() for a in aliases}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in (wanted or C.FIELD_ALIASES)]
    return df.select(*rest, *chosen)


def temperature_proxy(pressure: Column, density: Column) -> Column:
    """p/rho where both are finite and rho is positive, else 0 (PRJ19)."""
    usable = finite(pressure) & finite_positive(density)
    return F.when(usable, pressure / density).otherwise(0.0)


def normalize_maps(df: DataFrame, maps: dict[str, tuple[float, str]], mode: str = "mean",
                   keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Scale maps so that their mean or maximum over finite positive cells is a reference (PRJ18).

    ``maps`` names, for each value column, the reference and the output column. One aggregate measures all of them. A
    frame without such cells, or with a bad denominator, is divided by 1.
    """
    if mode == "none":
        return df.withColumns({out: F.col(value) * float(reference) for value, (reference, out) in maps.items()})
    if mode not in ("mean", "max"):
        raise ValueError(f"unsupported normalization: {mode}")
    found = F.avg if mode == "mean" else F.max
    scale = df.groupBy(*keys).agg(*[found(F.when(finite_positive(F.col(v)), F.col(v))).alias(f"_m_{v}") for v in maps])

    def denominator(value: str) -> Column:
        usable = F.coalesce(finite_positive(F.col(f"_m_{value}")), F.lit(False))
        return F.when(usable, F.col(f"_m_{value}")).otherwise(1.0)

    return (df.join(scale, list(keys))
            .withColumns({out: F.col(value) / denominator(value) * float(reference) for value, (reference, out) in maps.items()})
            .drop(*[f"_m_{v}" for v in maps]))


def normalize_map(df: DataFrame, value: str, reference: float, mode: str = "mean",
                  keys: tuple[str, ...] = ("frame",), out: str | None = None) -> DataFrame:
    """One map as :func:`normalize_maps` scales it (PRJ18)."""
    return normalize_maps(df, {value: (reference, out or value)}, mode, keys)


def background_maps(fluid: DataFrame, density_cm3: float, temperature_mk: float,
                    mode: str = "mean", keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Background table from density and pressure with raw values and provenance (SNK13, SRC8)."""
    proxy = fluid.withColumn("temperature_proxy", temperature_proxy(F.col("pressure"), F.col("rho")))
    scaled = normalize_maps(proxy, {"rho": (density_cm3, "thermal_density_cm3"), "temperature_proxy": (temperature_mk, "temperature_mk")}, mode, keys)
    return scaled.withColumns({
        "normalization": F.lit(mode), "reference_density_cm3": F.lit(float(density_cm3)),
        "reference_temperature_mk": F.lit(float(temperature_mk))})


