"""Packages the lookup table of territory names, after the other tables are built: python tools/build_territory_names.py"""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexigrain import refdata  # noqa: E402
from lexigrain.operators.territories import name_table  # noqa: E402

if __name__ == "__main__":
    rows = [{"name_norm": k, "code": c, "strength": s, "ord": i} for i, (k, (c, s)) in enumerate(name_table().items())]
    pq.write_table(pa.Table.from_pylist(rows), refdata.FOLDER / "territory_names.parquet", compression="zstd")
    print(len(rows))
