"""python -m tidemark.dispatch REQUEST.json: one operation over Parquet or JSON records, the result as JSON lines."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, finance, lifecycle, quality
from tidemark.operators.checks import ValidationError


def _instant(text: str):
    return F.lit(text).cast("timestamp")


OPERATIONS = {
    "lifecycle": lambda t, o: lifecycle.lifecycle_asof(t["records"], _instant(o["effective_at"]), _instant(o["known_at"])),
    "status": lambda t, o: asof.permission_asof(t["records"], _instant(o["effective_at"]), _instant(o["known_at"])),
    "macro": lambda t, o: asof.macro_asof(t["records"], _instant(o["at"]), latest_observation=o.get("latest_observation", False)),
    "lookthrough": lambda t, o: finance.look_through(t["records"], t["allocations"], _instant(o["at"])),
    "reconcile": lambda t, o: quality.discrepancies(t["records"], _instant(o["at"]), o.get("tolerance", 0.0)),
    "units": lambda t, o: finance.trading_units(t["records"], **o),
    "ttm": lambda t, o: finance.ttm_facts(t["records"], _instant(o["at"]), allow_mixed_vintages=o.get("allow_mixed_vintages", False)),
    "pit": lambda t, o: asof.point_in_time_join(t["records"], t["facts"], time=o["time"], available=o["available"], by=tuple(o["by"]), max_age=o.get("max_age")),
}


def run_request(spark: SparkSession, request: dict) -> DataFrame:
    """request: operation, tables (name -> path of Parquet), options."""
    if request.get("operation") not in OPERATIONS:
        raise ValidationError(f"operation must be one of {sorted(OPERATIONS)}")
    tables = {n: spark.read.parquet(p) for n, p in request["tables"].items()}
    return OPERATIONS[request["operation"]](tables, request.get("options", {}))


if __name__ == "__main__":
    from tidemark.session import local_session

    for row in run_request(local_session("*"), json.loads(Path(sys.argv[1]).read_text())).toJSON().toLocalIterator():
        print(row)
