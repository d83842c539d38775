"""Compare registered queries with their SQL: ``python tests/llm/verify.py [name ...]`` (``SF``: folder)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from plumbline.llm.queries import ORACLES, QUERIES  # noqa: E402
from plumbline.session import get_session  # noqa: E402
from tests.verify import difference, oracle_connection  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        got = QUERIES[name](spark, sf)
        if name in ORACLES:
            want = con.sql(ORACLES[name])
            print(name, difference(got, want.columns, want.fetchall()) or "ok", round(time.time() - start, 1), flush=True)
        else:
            print(name, got.count(), "rows", got.dtypes, round(time.time() - start, 1), flush=True)
