"""Print the physical plan tree of registered queries (after execution, so
AQE's final plan is shown).  Usage: python tools/explain.py [sf_dir] name ..."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from itemlens.queries import QUERIES  # noqa: E402
from itemlens.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session("local[8]", 16, driver_memory="8g")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"===== {name}")
        print(df._jdf.queryExecution().executedPlan().toString())
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
