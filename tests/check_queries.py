"""Command line: compares all queries, or the named ones, on one lake folder."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeaccord.plans import registry
from lakeaccord.session import local_session
from tests.oracle import compare

folder, names = sys.argv[1], sys.argv[2:]
spark = local_session("check")
spark.sparkContext.setLogLevel("ERROR")
bad = 0
for name, (run, sql) in registry().items():
    if names and name not in names:
        continue
    try:
        result = compare(spark, folder, run, sql)
    except Exception as error:
        result = {"problem": f"{type(error).__name__}: {str(error)[:1500]}"}
    bad += bool(result["problem"])
    print(("ok  " if not result["problem"] else "BAD ") + name, result, flush=True)
print("problems:", bad)
