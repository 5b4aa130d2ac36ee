"""Sea-water carbonate equilibrium as SQL expressions.

Constants are on the total pH scale in mol per kg of sea water, temperature in
degrees Celsius, salinity in practical units, pressure in bar. Sources:

* carbonic acid: Millero, Graham, Huang, Bustos-Serrano, Pierrot (2006)
* bisulfate: Dickson (1990); hydrogen fluoride: Dickson and Riley (1979) /
  Dickson and Goyet (1994); borate: Dickson (1990), total boron Uppstrom (1974)
* water, phosphoric and silicic acid: Millero (1995)
* CO2 solubility and fugacity: Weiss (1974)
* pressure corrections: Millero (1995) with the corrections of Lewis and
  Wallace (1998)

Each step is a set of named expressions over the columns of the step before
it. They serve the reference SQL only; Spark runs the batch kernel.
"""

from __future__ import annotations

GAS = 83.14472  # cm3 bar per mol and kelvin


def _pressure(a0: float, a1: float, a2: float, b0: float, b1: float) -> str:
    """Pressure factor of a constant from its volume and compressibility change."""
    volume = f"({a0!r} + {a1!r} * cw_c + {a2!r} * cw_c * cw_c)"
    compress = f"({b0!r} + {b1!r} * cw_c)"
    return f"exp((-{volume} + 0.5e0 * {compress} * cw_p) * cw_p / cw_rt)"


# Inputs: cw_alk, cw_dic or cw_co2, cw_pt, cw_sit (mol/kg), cw_c (Celsius), cw_s, cw_p (bar).
BASICS = {
    "cw_t": "cw_c + 273.15e0",
    "cw_q": "sqrt(cw_s)",
    "cw_i": "19.924e0 * cw_s / (1000e0 - 1.005e0 * cw_s)",
}

LOGS = {
    "cw_l": "ln(cw_t)",
    "cw_iq": "sqrt(cw_i)",
    "cw_rt": f"{GAS} * cw_t",
    "cw_d": "ln(1e0 - 0.001005e0 * cw_s)",
}

# Totals, surface and in-place bisulfate and fluoride (free scale).
ACIDS = {
    "cw_bt": "0.000416e0 * cw_s / 35e0",
    "cw_st": "0.14e0 / 96.062e0 * cw_s / 1.80655e0",
    "cw_ft": "0.000067e0 / 18.998e0 * cw_s / 1.80655e0",
    "cw_ks0": (
        "exp(-4276.1e0 / cw_t + 141.328e0 - 23.093e0 * cw_l"
        " + (-13856e0 / cw_t + 324.57e0 - 47.986e0 * cw_l) * cw_iq"
        " + (35474e0 / cw_t - 771.54e0 + 114.723e0 * cw_l) * cw_i"
        " - 2698e0 / cw_t * cw_i * cw_iq + 1776e0 / cw_t * cw_i * cw_i + cw_d)"
    ),
    "cw_kf0": "exp(1590.2e0 / cw_t - 12.641e0 + 1.525e0 * cw_iq + cw_d)",
    "cw_pks": _pressure(-18.03, 0.0466, 0.316e-3, -4.53e-3, 0.09e-3),
    "cw_pkf": _pressure(-9.78, -0.0090, -0.942e-3, -3.91e-3, 0.054e-3),
}

# Scale factors: cw_zs total over free; cw_g0, cw_gp total over sea-water scale.
SCALES = {
    "cw_ks": "cw_ks0 * cw_pks",
    "cw_kf": "cw_kf0 * cw_pkf",
    "cw_g0": "(1e0 + cw_st / cw_ks0) / (1e0 + cw_st / cw_ks0 + cw_ft / cw_kf0)",
    "cw_zs": "1e0 + cw_st / (cw_ks0 * cw_pks)",
    "cw_gp": (
        "(1e0 + cw_st / (cw_ks0 * cw_pks))"
        " / (1e0 + cw_st / (cw_ks0 * cw_pks) + cw_ft / (cw_kf0 * cw_pkf))"
    ),
}

CONSTANTS = {
    "cw_k1": (
        "exp(-2.302585092994046e0 * (6320.813e0 / cw_t - 126.34048e0 + 19.568224e0 * cw_l"
        " + 13.4191e0 * cw_q + 0.0331e0 * cw_s - 5.33e-5 * cw_s * cw_s"
        " + (-530.123e0 * cw_q - 6.103e0 * cw_s) / cw_t - 2.0695e0 * cw_q * cw_l))"
        f" * {_pressure(-25.50, 0.1271, 0.0, -3.08e-3, 0.0877e-3)} * cw_gp"
    ),
    "cw_k2": (
        "exp(-2.302585092994046e0 * (5143.692e0 / cw_t - 90.18333e0 + 14.613358e0 * cw_l"
        " + 21.0894e0 * cw_q + 0.1248e0 * cw_s - 3.687e-4 * cw_s * cw_s"
        " + (-772.483e0 * cw_q - 20.051e0 * cw_s) / cw_t - 3.3336e0 * cw_q * cw_l))"
        f" * {_pressure(-15.82, -0.0219, 0.0, 1.13e-3, -0.1475e-3)} * cw_gp"
    ),
    "cw_kb": (
        "exp((-8966.90e0 - 2890.53e0 * cw_q - 77.942e0 * cw_s + 1.728e0 * cw_s * cw_q"
        " - 0.0996e0 * cw_s * cw_s) / cw_t + 148.0248e0 + 137.1942e0 * cw_q + 1.62142e0 * cw_s"
        " + (-24.4344e0 - 25.085e0 * cw_q - 0.2474e0 * cw_s) * cw_l + 0.053105e0 * cw_q * cw_t)"
        f" / cw_g0 * {_pressure(-29.48, 0.1622, -2.608e-3, -2.84e-3, 0.0)} * cw_gp"
    ),
    "cw_kw": (
        "exp(-13847.26e0 / cw_t + 148.9802e0 - 23.6521e0 * cw_l"
        " + (118.67e0 / cw_t - 5.977e0 + 1.0495e0 * cw_l) * cw_q - 0.01615e0 * cw_s)"
        f" * {_pressure(-20.02, 0.1119, -1.409e-3, -5.13e-3, 0.0794e-3)} * cw_gp"
    ),
    "cw_kp1": (
        "exp(-4576.752e0 / cw_t + 115.540e0 - 18.453e0 * cw_l"
        " + (-106.736e0 / cw_t + 0.69171e0) * cw_q + (-0.65643e0 / cw_t - 0.01844e0) * cw_s)"
        f" * {_pressure(-14.51, 0.1211, -0.321e-3, -2.67e-3, 0.0427e-3)} * cw_gp"
    ),
    "cw_kp2": (
        "exp(-8814.715e0 / cw_t + 172.1033e0 - 27.927e0 * cw_l"
        " + (-160.340e0 / cw_t + 1.3566e0) * cw_q + (0.37335e0 / cw_t - 0.05778e0) * cw_s)"
        f" * {_pressure(-23.12, 0.1758, -2.647e-3, -5.15e-3, 0.09e-3)} * cw_gp"
    ),
    "cw_kp3": (
        "exp(-3070.75e0 / cw_t - 18.126e0"
        " + (17.27039e0 / cw_t + 2.81197e0) * cw_q + (-44.99486e0 / cw_t - 0.09984e0) * cw_s)"
        f" * {_pressure(-26.57, 0.2020, -3.042e-3, -4.08e-3, 0.0714e-3)} * cw_gp"
    ),
    "cw_ksi": (
        "exp(-8904.2e0 / cw_t + 117.400e0 - 19.334e0 * cw_l"
        " + (-458.79e0 / cw_t + 3.5913e0) * cw_iq + (188.74e0 / cw_t - 1.5998e0) * cw_i"
        " + (-12.1652e0 / cw_t + 0.07871e0) * cw_i * cw_i + cw_d)"
        f" * {_pressure(-29.48, 0.1622, -2.608e-3, -2.84e-3, 0.0)} * cw_gp"
    ),
    # Solubility (mol/kg/atm) and fugacity over partial pressure at one atmosphere.
    "cw_k0": (
        "exp(9345.17e0 / cw_t - 60.2409e0 + 23.3585e0 * ln(cw_t / 100e0)"
        " + cw_s * (0.023517e0 - 0.00023656e0 * cw_t + 0.0047036e-4 * cw_t * cw_t))"
    ),
    "cw_fug": (
        "exp((-1636.75e0 + 12.0408e0 * cw_t - 0.0327957e0 * cw_t * cw_t"
        " + 3.16528e-5 * cw_t * cw_t * cw_t + 2e0 * (57.7e0 - 0.118e0 * cw_t))"
        " * 1.01325e0 / cw_rt)"
    ),
}

PREPARATION = (BASICS, LOGS, ACIDS, SCALES, CONSTANTS)


def other_alkalinity(h: str) -> str:
    """Alkalinity apart from carbonate, as a function of the proton concentration."""
    return (
        f"(cw_bt * cw_kb / (cw_kb + {h}) + cw_kw / {h} + cw_sit * cw_ksi / (cw_ksi + {h})"
        f" + cw_pt * ((cw_kp1 * cw_kp2 * ({h} + 2e0 * cw_kp3) - {h} * {h} * {h})"
        f" / ({h} * {h} * {h} + cw_kp1 * ({h} * {h} + cw_kp2 * ({h} + cw_kp3))))"
        f" - {h} / cw_zs - cw_st / (1e0 + cw_ks * cw_zs / {h})"
        f" - cw_ft / (1e0 + cw_kf * cw_zs / {h}))"
    )


def carbonate_from_dic(h: str, dic: str) -> str:
    return (
        f"({dic} * cw_k1 * ({h} + 2e0 * cw_k2)"
        f" / ({h} * {h} + cw_k1 * ({h} + cw_k2)))"
    )


def carbonate_from_co2(h: str, co2: str) -> str:
    return f"({co2} * cw_k1 * ({h} + 2e0 * cw_k2) / ({h} * {h}))"


def co2_from_dic(h: str, dic: str) -> str:
    return f"({dic} * {h} * {h} / ({h} * {h} + cw_k1 * ({h} + cw_k2)))"


def dic_from_co2(h: str, co2: str) -> str:
    return f"({co2} * (1e0 + cw_k1 / {h} + cw_k1 * cw_k2 / ({h} * {h})))"
