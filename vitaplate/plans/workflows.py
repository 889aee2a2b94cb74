"""From exported files to the operators' column names.

The operators use short column roles (exp_id, patient, compound,
concentration, day, ld, plate_row, plate_col); exported sheets use the
instrument's headers.  ``objects_from_exports`` reads a folder of exported
experiments and returns the cleaned, typed object table every operator in
``vitaplate.operators`` accepts; feature columns keep their headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaplate.operators.clean import clean_input, infer_numeric, infer_types
from vitaplate.sources.files import read_experiments

# Export header -> operator column role.
EXPORT_COLUMNS = {
    "ExpID": "exp_id",
    "Cell Type": "patient",
    "Compound": "compound",
    "Concentration": "concentration",
    "Day": "day",
    "LD": "ld",
    "Row": "plate_row",
    "Column": "plate_col",
}

# Text columns that stay labels even when every value looks numeric (a patient id, a row letter).
LABEL_COLUMNS = ("ExpID", "Cell Type", "Compound", "LD", "Row")


def objects_from_exports(spark: SparkSession, raw_dir: str, fmt: str = "csv", repair_embedded_dose: bool = False, all_types: bool = False) -> DataFrame:
    """S1-S5 -> P1-P6: every exported sheet as one typed object table with operator column names.

    Numbers are typed; with ``all_types`` also truth values, whole numbers and dates.
    """
    raw = read_experiments(spark, raw_dir, fmt=fmt)
    cleaned = clean_input(raw, compound="Compound", concentration="Concentration", patient="Cell Type",
                          repair_embedded_dose=repair_embedded_dose)
    infer = infer_types if all_types else infer_numeric
    typed = infer(cleaned, columns=[c for c in cleaned.columns if c not in LABEL_COLUMNS])
    out = typed.withColumnsRenamed({k: v for k, v in EXPORT_COLUMNS.items() if k in typed.columns})
    if "plate_col" in out.columns:
        out = out.withColumn("plate_col", F.col("plate_col").cast("int"))
    return out
