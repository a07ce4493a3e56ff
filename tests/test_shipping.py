"""Queries with Arrow functions from a driver that was started elsewhere."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from __spark_entry__ import queries
from talkmill.session import local_session
spark = local_session("2", "elsewhere", **{{"spark.sql.shuffle.partitions": "2"}})
for name in "vector_topk vector_topk_filtered similar_messages precision_at_k overlap_at_k hybrid_rrf".split():
    print(name, len(queries()[name](spark, {data!r}).collect()))
"""


def test_workers_find_the_package(data, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=600,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert [int(line.split()[1]) > 0 for line in done.stdout.splitlines() if line.count(" ") == 1].count(True) == 6
