"""Sea-water carbonate equilibrium for batches of cells.

Total pH scale, mol per kg of sea water, degrees Celsius, practical salinity,
bar. Sources of the fixed values below:

* carbonic acid: Millero, Graham, Huang, Bustos-Serrano, Pierrot (2006)
* bisulfate: Dickson (1990); hydrogen fluoride: Dickson and Riley (1979) /
  Dickson and Goyet (1994); borate: Dickson (1990), total boron Uppstrom (1974)
* water, phosphoric and silicic acid: Millero (1995)
* CO2 solubility and fugacity: Weiss (1974)
* pressure: Millero (1995) with the corrections of Lewis and Wallace (1998)

The functions take and return NumPy arrays: an Arrow batch of cells is solved
at once, NaN marks a missing value and spreads to the result. A sample that has not
converged is missing.
"""

from __future__ import annotations

import numpy as np

GAS = 83.14472  # cm3 bar per mol and kelvin
LN10 = 2.302585092994046

# Volume change (a0, a1, a2) and compressibility change (b0, b1).
PRESSURE_TERMS = {
    "k1": (-25.50, 0.1271, 0.0, -3.08e-3, 0.0877e-3),
    "k2": (-15.82, -0.0219, 0.0, 1.13e-3, -0.1475e-3),
    "kb": (-29.48, 0.1622, -2.608e-3, -2.84e-3, 0.0),
    "kw": (-20.02, 0.1119, -1.409e-3, -5.13e-3, 0.0794e-3),
    "ks": (-18.03, 0.0466, 0.316e-3, -4.53e-3, 0.09e-3),
    "kf": (-9.78, -0.0090, -0.942e-3, -3.91e-3, 0.054e-3),
    "kp1": (-14.51, 0.1211, -0.321e-3, -2.67e-3, 0.0427e-3),
    "kp2": (-23.12, 0.1758, -2.647e-3, -5.15e-3, 0.09e-3),
    "kp3": (-26.57, 0.2020, -3.042e-3, -4.08e-3, 0.0714e-3),
    "ksi": (-29.48, 0.1622, -2.608e-3, -2.84e-3, 0.0),
}

NEWTON_STEPS = 40
LARGEST_STEP = 2.0
TOLERANCE = 1e-13


class Equilibrium:
    """Constants and acid totals of a batch of water samples."""

    def __init__(self, salt, temp, pressure, phosphate, silicate):
        s, t, p = salt, temp + 273.15, pressure
        log_t, root_s = np.log(t), np.sqrt(s)
        ionic = 19.924 * s / (1000.0 - 1.005 * s)
        root_i = np.sqrt(ionic)
        per_kg = np.log(1.0 - 0.001005 * s)

        def compressed(name):
            a0, a1, a2, b0, b1 = PRESSURE_TERMS[name]
            volume = a0 + a1 * temp + a2 * temp * temp
            return np.exp((-volume + 0.5 * (b0 + b1 * temp) * p) * p / (GAS * t))

        self.phosphate, self.silicate = phosphate, silicate
        self.borate = 0.000416 * s / 35.0
        self.sulfate = 0.14 / 96.062 * s / 1.80655
        self.fluoride = 0.000067 / 18.998 * s / 1.80655

        ks_surface = np.exp(
            -4276.1 / t + 141.328 - 23.093 * log_t
            + (-13856.0 / t + 324.57 - 47.986 * log_t) * root_i
            + (35474.0 / t - 771.54 + 114.723 * log_t) * ionic
            - 2698.0 / t * ionic * root_i + 1776.0 / t * ionic**2 + per_kg
        )
        kf_surface = np.exp(1590.2 / t - 12.641 + 1.525 * root_i + per_kg)
        self.ks = ks_surface * compressed("ks")
        self.kf = kf_surface * compressed("kf")
        self.total_per_free = 1.0 + self.sulfate / self.ks
        to_total_surface = self._to_total(ks_surface, kf_surface)
        to_total = self._to_total(self.ks, self.kf)

        pk1 = (
            6320.813 / t - 126.34048 + 19.568224 * log_t
            + 13.4191 * root_s + 0.0331 * s - 5.33e-5 * s * s
            + (-530.123 * root_s - 6.103 * s) / t - 2.0695 * root_s * log_t
        )
        pk2 = (
            5143.692 / t - 90.18333 + 14.613358 * log_t
            + 21.0894 * root_s + 0.1248 * s - 3.687e-4 * s * s
            + (-772.483 * root_s - 20.051 * s) / t - 3.3336 * root_s * log_t
        )
        ln_kb = (
            (-8966.90 - 2890.53 * root_s - 77.942 * s + 1.728 * s * root_s - 0.0996 * s * s) / t
            + 148.0248 + 137.1942 * root_s + 1.62142 * s
            + (-24.4344 - 25.085 * root_s - 0.2474 * s) * log_t + 0.053105 * root_s * t
        )
        ln_kw = (
            -13847.26 / t + 148.9802 - 23.6521 * log_t
            + (118.67 / t - 5.977 + 1.0495 * log_t) * root_s - 0.01615 * s
        )
        ln_kp1 = (
            -4576.752 / t + 115.540 - 18.453 * log_t
            + (-106.736 / t + 0.69171) * root_s + (-0.65643 / t - 0.01844) * s
        )
        ln_kp2 = (
            -8814.715 / t + 172.1033 - 27.927 * log_t
            + (-160.340 / t + 1.3566) * root_s + (0.37335 / t - 0.05778) * s
        )
        ln_kp3 = (
            -3070.75 / t - 18.126
            + (17.27039 / t + 2.81197) * root_s + (-44.99486 / t - 0.09984) * s
        )
        ln_ksi = (
            -8904.2 / t + 117.400 - 19.334 * log_t
            + (-458.79 / t + 3.5913) * root_i + (188.74 / t - 1.5998) * ionic
            + (-12.1652 / t + 0.07871) * ionic**2 + per_kg
        )
        # Sea-water scale at the surface, then compressed, then to the total scale.
        self.k1 = np.exp(-LN10 * pk1) * compressed("k1") * to_total
        self.k2 = np.exp(-LN10 * pk2) * compressed("k2") * to_total
        self.kb = np.exp(ln_kb) / to_total_surface * compressed("kb") * to_total
        self.kw = np.exp(ln_kw) * compressed("kw") * to_total
        self.kp1 = np.exp(ln_kp1) * compressed("kp1") * to_total
        self.kp2 = np.exp(ln_kp2) * compressed("kp2") * to_total
        self.kp3 = np.exp(ln_kp3) * compressed("kp3") * to_total
        self.ksi = np.exp(ln_ksi) * compressed("ksi") * to_total

        # Solubility in mol/kg/atm and fugacity per partial pressure at one atmosphere.
        h = t / 100.0
        self.k0 = np.exp(
            93.4517 / h - 60.2409 + 23.3585 * np.log(h)
            + s * (0.023517 - 0.023656 * h + 0.0047036 * h * h)
        )
        virial = -1636.75 + 12.0408 * t - 0.0327957 * t**2 + 3.16528e-5 * t**3
        self.fugacity = np.exp((virial + 2.0 * (57.7 - 0.118 * t)) * 1.01325 / (GAS * t))

    def _to_total(self, ks, kf):
        bisulfate = 1.0 + self.sulfate / ks
        return bisulfate / (bisulfate + self.fluoride / kf)

    def minor_alkalinity(self, h):
        """Alkalinity other than carbonate and the leading part of its slope in ln h."""
        k12 = self.kp1 * self.kp2
        k123 = k12 * self.kp3
        borate = self.borate * self.kb / (self.kb + h)
        silicate = self.silicate * self.ksi / (self.ksi + h)
        hydroxide = self.kw / h
        free = h / self.total_per_free
        value = (
            borate + silicate + hydroxide - free
            + self.phosphate * (k12 * h + 2.0 * k123 - h**3)
            / (h**3 + self.kp1 * h * h + k12 * h + k123)
            - self.sulfate / (1.0 + self.ks / free)
            - self.fluoride / (1.0 + self.kf / free)
        )
        slope = (
            -borate * h / (self.kb + h) - silicate * h / (self.ksi + h) - hydroxide - free
        )
        return value, slope

    def protons(self, alk, carbonate):
        """[H+] at which the alkalinity is ``alk``; ``carbonate`` gives value and slope."""
        h = np.full_like(alk, 1e-8)
        moving = np.ones(alk.shape, bool)
        for _ in range(NEWTON_STEPS):
            minor, minor_slope = self.minor_alkalinity(h)
            major, major_slope = carbonate(h)
            step = np.clip(
                -(major + minor - alk) / (major_slope + minor_slope), -LARGEST_STEP, LARGEST_STEP
            )
            # a sample stops by itself, so its result does not depend on its batch
            h = np.where(moving, h * np.exp(step), h)
            moving &= np.abs(step) > TOLERANCE
            if not moving.any():
                break
        return np.where(moving, np.nan, h)


def _pco2(eq, alk, dic):
    def carbonate(h):
        pool = h * h + eq.k1 * h + eq.k1 * eq.k2
        value = dic * (eq.k1 * h + 2.0 * eq.k1 * eq.k2) / pool
        slope = -dic * eq.k1 * h * (h * h + 4.0 * eq.k2 * h + eq.k1 * eq.k2) / pool**2
        return value, slope

    h = eq.protons(alk, carbonate)
    co2 = dic * h * h / (h * h + eq.k1 * h + eq.k1 * eq.k2)
    return co2 / eq.k0 / eq.fugacity * 1e6


def _dic(eq, alk, pco2):
    co2 = pco2 * 1e-6 * eq.fugacity * eq.k0

    def carbonate(h):
        single = co2 * eq.k1 / h
        double = single * eq.k2 / h
        return single + 2.0 * double, -(single + 4.0 * double)

    h = eq.protons(alk, carbonate)
    return co2 * (1.0 + eq.k1 / h + eq.k1 * eq.k2 / (h * h))


def pco2_from_dic(alk, dic, salt, temp, pressure, phosphate, silicate):
    """pCO2 in microatmospheres from alkalinity and DIC."""
    return _pco2(Equilibrium(salt, temp, pressure, phosphate, silicate), alk, dic)


def dic_from_pco2(alk, pco2, salt, temp, pressure, phosphate, silicate):
    """DIC in mol/kg from alkalinity and pCO2 in microatmospheres."""
    return _dic(Equilibrium(salt, temp, pressure, phosphate, silicate), alk, pco2)


def response(alk, dic, more, salt, temp, pressure, phosphate, silicate):
    """pCO2, pCO2 at alkalinity ``more``, and DIC at ``more`` and the first pCO2."""
    eq = Equilibrium(salt, temp, pressure, phosphate, silicate)
    before = _pco2(eq, alk, dic)
    return before, _pco2(eq, more, dic), _dic(eq, more, before)
