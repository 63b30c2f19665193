"""Time registered queries without collecting them: python tests/time_queries.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from curaspark.plans.catalog import all_queries
from curaspark.session import local_session

spark = local_session()
sf_dir, names = sys.argv[1], sys.argv[2:]
for name, fn in all_queries().items():
    if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
        continue
    best = []
    for _ in range(2):
        start = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        best.append(time.time() - start)
    print(f"@ {name:32s} first {best[0]:6.2f}s again {best[1]:6.2f}s", flush=True)
