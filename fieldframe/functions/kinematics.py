"""Relativistic kinematics, status and species (PRJ1-PRJ8, PRJ40, PRJ41)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions import constants as C


def gamma(p: Column, mass: Column, c: Column) -> Column:
    """Lorentz factor of a momentum magnitude."""
    q = p / (mass * c)
    return F.sqrt(q * q + 1.0)


def speed(p: Column, mass: Column, c: Column) -> Column:
    return p / (gamma(p, mass, c) * mass)


def kinetic_energy(p: Column, mass: Column, c: Column) -> Column:
    """(gamma-1) m c^2 in code units."""
    return (gamma(p, mass, c) - 1.0) * mass * c * c


def kinetic_energy_ev(p: Column, mass: Column, c: Column, energy_scale_erg: Column) -> Column:
    return kinetic_energy(p, mass, c) * energy_scale_erg / C.ELECTRON_VOLT


def momentum_magnitude(p: Column | None, px: Column, py: Column, pz: Column) -> Column:
    """Scalar momentum where stored, else the norm of the vector (PRJ2)."""
    norm = F.sqrt(px * px + py * py + pz * pz)
    return norm if p is None else F.coalesce(p, norm)


def transport_energy_kev(p: Column, p0: float, p0_energy_kev: float) -> Column:
    """Kinetic energy on the scale where momentum p0 has the given energy (PRJ5)."""
    if p0 <= 0.0 or p0_energy_kev <= 0.0:
        raise ValueError("p0 and its energy must be positive")
    reference = math.sqrt(1.0 + p0 * p0) - 1.0
    if reference <= 0.0:
        raise ValueError("p0 gives no positive kinetic energy")
    return (F.sqrt(p * p + 1.0) - 1.0) / reference * float(p0_energy_kev)


def energy_source(species: Column, mass: Column, c: Column, energy_scale: Column,
                  requested: str = "auto") -> Column:
    """Energy coordinate in force; placeholder metadata selects transport units (PRJ3)."""
    if requested != "auto":
        return F.lit(requested)
    placeholder = ((species == C.SPECIES_CUSTOM) & (mass == 1.0) & (c == 1.0)
                   & (energy_scale == 1.0))
    return F.when(placeholder, "transport-p0-kinetic-kev").otherwise("snapshot-kinetic")


def energy_ev(p: Column, source: Column, mass: Column, c: Column, energy_scale: Column,
              p0: float = 0.1, p0_energy_kev: float = 1.0) -> Column:
    """Energy in eV for each of the four sources; an unknown source fails the query (PRJ4)."""
    transport = transport_energy_kev(p, p0, p0_energy_kev) * 1.0e3
    return (
        F.when(source.isin("transport-p0-kinetic-kev", "transport-p0-kev"), transport)
        .when(source == "momentum-kev", p * 1.0e3)
        .when(source == "snapshot-kinetic", kinetic_energy_ev(p, mass, c, energy_scale))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported energy source: "), source)).cast("double"))
    )


def status_flags(status: Column) -> dict[str, Column]:
    """0/1 columns per lifecycle state (PRJ6)."""
    return {
        "is_active": (status == C.STATUS_ACTIVE).cast("int"),
        "is_escaped": (status == C.STATUS_ESCAPED).cast("int"),
        "is_inactive": (status == C.STATUS_INACTIVE).cast("int"),
    }


def _species(code: Column, position: int, default) -> Column:
    result = None
    for row in C.SPECIES:
        result = (F.when(code == row[0], F.lit(row[position])) if result is None
                  else result.when(code == row[0], F.lit(row[position])))
    return result.otherwise(F.lit(default))


def species_name(code: Column) -> Column:
    """Species name; unknown codes are custom (PRJ7)."""
    return _species(code, 1, "custom")


def species_mass(code: Column) -> Column:
    """CGS mass by species (PRJ8)."""
    return _species(code, 2, 1.0)


def species_charge(code: Column) -> Column:
    """CGS charge by species (PRJ8)."""
    return _species(code, 3, 1.0)


def pitch_angle_policy(model: Column, mode: Column, mean: Column, variance: Column) -> dict[str, Column]:
    """Only the focused transport model carries a physical pitch angle (PRJ40)."""
    focused = model == "focused"
    return {
        "pitch_angle_mode": F.when(focused, mode).otherwise("unavailable"),
        "mean_mu": F.when(focused, mean).otherwise(0.0),
        "var_mu": F.when(focused, variance).otherwise(0.0),
    }


def alfven_time_seconds(length_m: float = C.ALFVEN_LENGTH_M, field_g: float = C.ALFVEN_FIELD_G,
                        density_cm3: float = C.ALFVEN_DENSITY_CM3) -> float:
    """Seconds per code time unit: a length over the Alfven speed (PRJ41)."""
    speed_cm = field_g / math.sqrt(4.0 * math.pi * density_cm3 * C.ALFVEN_PROTON_MASS_G)
    if length_m <= 0.0 or speed_cm <= 0.0:
        raise ValueError("the Alfven normalization must be positive")
    return length_m / (speed_cm / 100.0)


def frame_time(frame: Column, dt_out: float, time_unit_seconds: float = 1.0) -> Column:
    """Frame number to time (PRJ41)."""
    return frame.cast("double") * float(dt_out) * float(time_unit_seconds)
