"""Run registered queries against their SQL twins: ``check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import importlib
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sweeplens.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    if names and names[0].startswith("@"):
        module = importlib.import_module(f"sweeplens.plans.catalog.{names[0][1:]}")
        queries, oracles, names = module.QUERIES, module.ORACLES, names[1:]
    else:
        entry = importlib.import_module("__spark_entry__")
        queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, oracles[name], con)
            else:
                ok, note = True, f"{len(df.collect())} rows (no oracle)"
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
