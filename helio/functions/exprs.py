"""Column functions (P1–P14): pure expressions, evaluated inside whole-stage codegen.

Every function takes and returns ``Column`` objects so that it composes into a
single projection; none of them shuffles or calls Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from helio.schema import (FLARE_CLASS_CODES, FLARE_CUTS, FLARE_TOP, SEVERITY_CODES,
                          SEVERITY_CUTS, SEVERITY_TOP, STORM_KP)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """P5: NULL-preserving clip (``least``/``greatest`` alone skip NULLs)."""
    x = _c(x)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(float(hi)) if not isinstance(hi, Column) else hi)
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)) if not isinstance(lo, Column) else lo)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def cut_label(x, cuts: Sequence[tuple[float, str]], top: str) -> Column:
    """``x < cut_i -> label_i`` in order, else ``top`` (NULL falls to ``top``,
    like a chain of false comparisons on NaN)."""
    x = _c(x)
    expr = None
    for cut, label in cuts:
        cond = x < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(top))


def at_least_label(x, cuts: Sequence[tuple[float, str]], default: str | None) -> Column:
    """``x >= cut_i -> label_i`` for cuts given most severe first, else ``default``."""
    x = _c(x)
    expr = None
    for cut, label in cuts:
        cond = x >= F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def classify_flare(intensity) -> Column:
    """Flare intensity -> A/B/C/M/X."""
    return cut_label(intensity, FLARE_CUTS, FLARE_TOP)


def severity_label(kp) -> Column:
    """Kp -> Low/Moderate/High/Extreme."""
    return cut_label(kp, SEVERITY_CUTS, SEVERITY_TOP)


def storm_flag(kp) -> Column:
    """``kp >= 5`` as 0/1 (missing Kp compares false -> 0)."""
    return F.coalesce(_c(kp) >= F.lit(STORM_KP), F.lit(False)).cast("int")


def flare_intensity(xray_flux) -> Column:
    """``log10(xray + 1e-9) + 9`` rounded to 3 places."""
    return F.round(F.log10(_c(xray_flux) + F.lit(1e-9)) + F.lit(9.0), 3)


def code_of(x, codes: dict[str, int]) -> Column:
    """Map lookup with 0 for unknown or NULL labels."""
    pairs = []
    for k, v in codes.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(m, _c(x)), F.lit(0)).cast("int")


def flare_class_code(x) -> Column:
    """A..X -> 0..4, unknown -> 0."""
    return code_of(x, FLARE_CLASS_CODES)


def severity_code(x) -> Column:
    """Low..Extreme -> 0..3, unknown -> 0."""
    return code_of(x, SEVERITY_CODES)


def safe_float(s) -> Column:
    """Keep digits, '.', '-'; empty, lone sign/dot or unparsable -> 0.0."""
    cleaned = F.regexp_replace(_c(s).cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))


def strict_float(s) -> Column:
    """P7 variant that fails the whole job on an unparsable value (ANSI cast)."""
    return _c(s).cast("double")


def time_features(ts) -> dict[str, Column]:
    """Day of year, month, year and the yearly cycle (session tz UTC)."""
    ts = _c(ts)
    doy = F.dayofyear(ts)
    angle = F.lit(2 * math.pi) * doy / F.lit(365.0)
    return {
        "day_of_year": doy,
        "month": F.month(ts),
        "year": F.year(ts),
        "day_sin": F.sin(angle),
        "day_cos": F.cos(angle),
    }


def southward_bz(bz) -> Column:
    """``max(-bz, 0)``, NULL-preserving."""
    return clip(-_c(bz), lo=0.0)


def interactions(speed="solar_wind_speed", bz="imf_bz", density="solar_wind_density",
                 flare_code="flare_class_enc", kp="kp_index") -> dict[str, Column]:
    """Wind x southward Bz, wind^2 x density, flare code x Kp, southward Bz."""
    v, d = _c(speed), _c(density)
    return {
        "wind_bz_interaction": v * southward_bz(bz),
        "storm_energy": F.pow(v, F.lit(2.0)) * d,
        "flare_kp_interaction": _c(flare_code) * _c(kp),
        "southward_bz": southward_bz(bz),
    }


def log_features(cols: Sequence[str]) -> dict[str, Column]:
    """P10: ``log1p`` of skewed columns."""
    return {f"log_{c}": F.log1p(F.col(c)) for c in cols}


def display_label(name) -> Column:
    """``snake_case`` -> ``Title Case``."""
    return F.initcap(F.regexp_replace(_c(name), "_", " "))


def fixed_decimals(x, places: int = 2) -> Column:
    """Value text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", _c(x))


def bubble_size(x) -> Column:
    """``abs(coalesce(x, 1))``."""
    return F.abs(F.coalesce(_c(x), F.lit(1.0)))


def round6(x) -> Column:
    return F.round(_c(x), 6)
