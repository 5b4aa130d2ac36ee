"""Carbonate chemistry over whole grids: pCO2 and DIC of every cell.

Two problems are solved: pCO2 from alkalinity and DIC, and DIC from alkalinity
and pCO2. Both run as Arrow batch functions inside the scan's own tasks, with
no shuffle and no per-row call. They are the one place where the library
leaves the JVM: the iteration for the proton concentration, unrolled into
column expressions, outgrows the size limit of generated code and then runs
interpreted, many times slower than the batch form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellweave.functions import carbonate
from cellweave.functions.missing import ColumnLike, as_column
from cellweave.functions.physics import to_mmol_per_m3, to_mol_per_kg


@dataclass(frozen=True)
class Water:
    """Columns of the sea-water state; concentrations in mmol per m3, pressure in bar."""

    salt: ColumnLike = "salt"
    temp: ColumnLike = "temp"
    pressure: ColumnLike = "pressure"
    phosphate: ColumnLike = "po4"
    silicate: ColumnLike = "sio3"

    def columns(self) -> list[Column]:
        return [
            as_column(self.salt).cast("double"),
            as_column(self.temp).cast("double"),
            as_column(self.pressure).cast("double"),
            to_mol_per_kg(self.phosphate),
            to_mol_per_kg(self.silicate),
        ]


def _batch(solver, arrays) -> pa.Array:
    values = [a.to_numpy(zero_copy_only=False).astype(float) for a in arrays]
    with np.errstate(all="ignore"):
        result = solver(*values)
    return pa.array(result, mask=~np.isfinite(result))


@F.arrow_udf(DoubleType())
def _pco2(
    alk: pa.Array,
    dic: pa.Array,
    salt: pa.Array,
    temp: pa.Array,
    pressure: pa.Array,
    phosphate: pa.Array,
    silicate: pa.Array,
) -> pa.Array:
    return _batch(
        carbonate.pco2_from_dic, (alk, dic, salt, temp, pressure, phosphate, silicate)
    )


@F.arrow_udf(DoubleType())
def _dic(
    alk: pa.Array,
    pco2: pa.Array,
    salt: pa.Array,
    temp: pa.Array,
    pressure: pa.Array,
    phosphate: pa.Array,
    silicate: pa.Array,
) -> pa.Array:
    return _batch(
        carbonate.dic_from_pco2, (alk, pco2, salt, temp, pressure, phosphate, silicate)
    )


RESPONSE = StructType(
    [StructField(name, DoubleType()) for name in ("pco2_calc", "pco2_calc_pert", "dic_pert")]
)


@F.arrow_udf(RESPONSE)
def _response(
    alk: pa.Array,
    dic: pa.Array,
    more: pa.Array,
    salt: pa.Array,
    temp: pa.Array,
    pressure: pa.Array,
    phosphate: pa.Array,
    silicate: pa.Array,
) -> pa.Array:
    arrays = (alk, dic, more, salt, temp, pressure, phosphate, silicate)
    values = [a.to_numpy(zero_copy_only=False).astype(float) for a in arrays]
    with np.errstate(all="ignore"):
        solved = carbonate.response(*values)
    return pa.StructArray.from_arrays(
        [pa.array(r, mask=~np.isfinite(r)) for r in solved], names=RESPONSE.names
    )


def response(alk: ColumnLike, dic: ColumnLike, added: float, water: Water = Water()) -> Column:
    """Struct of pCO2, pCO2 with ``added`` alkalinity, and the DIC (mmol per m3) that then
    restores the first pCO2; the water's constants are worked out once for all three."""
    more = as_column(alk) + added
    solved = _response(to_mol_per_kg(alk), to_mol_per_kg(dic), to_mol_per_kg(more), *water.columns())
    return solved.withField("dic_pert", to_mmol_per_m3(solved["dic_pert"]))


def pco2(alk: ColumnLike, dic: ColumnLike, water: Water = Water()) -> Column:
    """pCO2 in microatmospheres of water with this alkalinity and DIC in mmol per m3."""
    return _pco2(to_mol_per_kg(alk), to_mol_per_kg(dic), *water.columns())


def dic(alk: ColumnLike, pco2_value: ColumnLike, water: Water = Water()) -> Column:
    """DIC in mmol per m3 at which water of this alkalinity has this pCO2."""
    return to_mmol_per_m3(
        _dic(to_mol_per_kg(alk), as_column(pco2_value).cast("double"), *water.columns())
    )


def removal_potential(
    control: DataFrame,
    treated: DataFrame,
    keys: list[str],
    water: Water = Water(),
) -> DataFrame:
    """Carbon the added alkalinity could take up, in mmol per m3 of each cell.

    ``control`` holds ``alk, dic`` and its water state, ``treated`` holds
    ``alk`` and its water state. The control pCO2 is solved once, before the
    join that repeats it for every treated run; cells without a partner drop out.
    """
    base = control.dropna("any").withColumn("pco2_calc", pco2("alk", "dic", water)).select(
        *keys, F.col("dic").alias("dic_con"), "pco2_calc"
    )
    joined = base.dropna("any").join(treated.dropna("any"), keys, "inner")
    return joined.withColumn("dic_calc", dic("alk", "pco2_calc", water)).withColumn(
        "ddic", F.col("dic_calc") - F.col("dic_con")
    )
