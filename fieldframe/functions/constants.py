"""Physical constants, binary formats, token tables."""

from __future__ import annotations

import math

# CGS physical constants.
SPEED_OF_LIGHT = 2.99792458e10
ELEMENTARY_CHARGE = 4.803204712570263e-10
BOLTZMANN = 1.380649e-16
PLANCK = 6.62607015e-27
ELECTRON_VOLT = 1.602176634e-12
PROTON_MASS = 1.67262192369e-24
ELECTRON_MASS = 9.1093837015e-28
ALPHA_MASS = 6.6446573357e-24
VACUUM_PERMEABILITY_FACTOR = 1.0
ASTRONOMICAL_UNIT = 1.495978707e13
SOLAR_RADIUS = 6.957e10
DAY = 86400.0
JULIAN_YEAR = 31557600.0
SFU = 1.0e-19
ARCSEC = math.pi / (180.0 * 3600.0)

# Energies and lengths used by the spectral-fit maps.
FIT_ARCSEC_CM = 7.27e7
FIT_KEV_ERG = 1.6e-9

# Alfven time normalization.
ALFVEN_LENGTH_M = 5.0e6
ALFVEN_FIELD_G = 50.0
ALFVEN_DENSITY_CM3 = 1.0e10
ALFVEN_PROTON_MASS_G = 1.6726219e-24

# Particle status and species codes.
STATUS_ACTIVE = 0
STATUS_ESCAPED = 1
STATUS_INACTIVE = 2
SPECIES = (
    # code, name, mass (g), charge (statC)
    (0, "proton", PROTON_MASS, ELEMENTARY_CHARGE),
    (1, "electron", ELECTRON_MASS, -ELEMENTARY_CHARGE),
    (2, "alpha", ALPHA_MASS, 2.0 * ELEMENTARY_CHARGE),
    (3, "custom", 1.0, 1.0),
)
SPECIES_CUSTOM = 3

# Binary formats.
PARTICLE_MAGIC = b"KPTPRT\0\0"
PARTICLE_MAGIC_V2 = b"KPTPRT1\0"
FIELD_MAGIC = b"KPTFLD1\0"
ENDIAN_MARKER = 0x01020304

# Symbol, name, exponents (L, M, T, Q, Theta), CGS value.
PHYSICAL_CONSTANTS = (
    ("pi", "pi", (0, 0, 0, 0, 0), math.pi),
    ("c", "speed of light", (1, 0, -1, 0, 0), SPEED_OF_LIGHT),
    ("e", "elementary charge", (0, 0, 0, 1, 0), ELEMENTARY_CHARGE),
    ("k_B", "Boltzmann constant", (2, 1, -2, 0, -1), BOLTZMANN),
    ("h", "Planck constant", (2, 1, -1, 0, 0), PLANCK),
    ("eV", "electron volt", (2, 1, -2, 0, 0), ELECTRON_VOLT),
    ("m_p", "proton mass", (0, 1, 0, 0, 0), PROTON_MASS),
    ("m_e", "electron mass", (0, 1, 0, 0, 0), ELECTRON_MASS),
    ("mu_0_factor", "Gaussian vacuum permeability factor", (0, 0, 0, 0, 0), 1.0),
    ("au", "astronomical unit", (1, 0, 0, 0, 0), ASTRONOMICAL_UNIT),
    ("R_sun", "nominal solar radius", (1, 0, 0, 0, 0), SOLAR_RADIUS),
    ("day", "day", (0, 0, 1, 0, 0), DAY),
    ("yr", "Julian year", (0, 0, 1, 0, 0), JULIAN_YEAR),
)

# Dimension exponents (L, M, T, Q, Theta) by quantity.
DIMENSIONS = {
    "dimensionless": (0, 0, 0, 0, 0),
    "length": (1, 0, 0, 0, 0),
    "mass": (0, 1, 0, 0, 0),
    "time": (0, 0, 1, 0, 0),
    "charge": (0, 0, 0, 1, 0),
    "temperature": (0, 0, 0, 0, 1),
    "velocity": (1, 0, -1, 0, 0),
    "acceleration": (1, 0, -2, 0, 0),
    "angular_frequency": (0, 0, -1, 0, 0),
    "diffusion_coefficient": (2, 0, -1, 0, 0),
    "number_density": (-3, 0, 0, 0, 0),
    "momentum": (1, 1, -1, 0, 0),
    "rigidity": (2, 1, -2, -1, 0),
    "energy": (2, 1, -2, 0, 0),
    "magnetic_field": (1, 1, -2, -1, 0),
    "electric_field": (1, 1, -2, -1, 0),
    "electric_potential": (2, 1, -2, -1, 0),
}

# Path token -> unit; the first token found in the path wins.
UNIT_TOKENS = (
    ("brightness_temperature", "K"),
    ("specific", "erg s^-1 cm^-2 Hz^-1 sr^-1"),
    ("flux_sfu", "sfu"),
    ("density_cm3", "cm^-3"),
    ("gauss", "G"),
    ("energy_ev", "eV"),
    ("energy_mev", "MeV"),
    ("freq_hz", "Hz"),
    ("frequencies_ghz", "GHz"),
    ("arcsec", "arcsec"),
    ("r_squared", ""),
    ("weight", "particle weight"),
    ("accepted", ""),
    ("index", ""),
)

# Fixed values: (intensity suffix, polarized suffix, derived name).
POLARIZATION_PAIRS = (
    ("I_flux_sfu", "V_flux_sfu", "circular_degree"),
    ("I_specific", "V_specific", "circular_degree"),
    ("I_brightness_temperature", "V_brightness_temperature", "circular_degree"),
    ("I_flux_sfu", "linear_flux_sfu", "linear_degree"),
    ("I_specific", "linear_specific", "linear_degree"),
    ("I_brightness_temperature", "linear_brightness_temperature", "linear_degree"),
)

# Path tokens of component-like curves.
COMPONENT_TOKENS = ("references/", "diagnostics/", "components/")

# Observing bands (name, lower GHz, upper GHz, upper edge included).
SPECTRUM_BANDS = (
    ("low_0.03_0.3GHz", 0.03, 0.3, False),
    ("mid_0.3_3GHz", 0.3, 3.0, False),
    ("high_3_10GHz", 3.0, 10.0, True),
)

# Limits of the reference-spectrum parameter variants.
THERMAL_ONLY_NONTHERMAL_1E7 = 1.0e-9
LOW_DENSITY_THERMAL_1E9 = 1.0e-6
THIN_DEPTH_FRACTION = 1.0e-5
THIN_DEPTH_MINIMUM_ARCSEC = 8.0e-5

# Variable name aliases of block-structured grids.
FIELD_ALIASES = {
    "bx": ("Bcc1", "B1", "B_x"),
    "by": ("Bcc2", "B2", "B_y"),
    "bz": ("Bcc3", "B3", "B_z"),
    "vx": ("vel1", "v1", "V1"),
    "vy": ("vel2", "v2", "V2"),
    "vz": ("vel3", "v3", "V3"),
    "rho": ("rho", "dens", "density", "d"),
    "pressure": ("press", "pressure", "prs", "pgas", "p"),
}

# Fixed value: a step record of a run log, its frame and seconds.
STEP_PATTERN = r"Step\s+(\d+)\s+takes\s+([0-9.+\-Ee]+)\s+seconds"

# Columns of the per-frame run summary.
RUN_SUMMARY_COLUMNS = (
    "frame", "time", "stored", "active", "inactive", "weight_sum", "p_min", "p_max",
    "p_avg", "dt_min", "dt_max", "dt_avg", "max_split_level", "injected", "split",
    "skipped_split_capacity", "read_seconds", "inject_seconds", "move_seconds",
    "split_seconds", "total_frame_seconds", "total_elapsed_seconds",
)
