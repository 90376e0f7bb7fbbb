"""The kernels must run on workers that cannot import the package."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from tonewheel.session import local_session
import __spark_entry__ as entry
spark = local_session("2")
for name in ("knn_anomaly_score", "group_pca", "stft_magnitude"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("shipped")
"""


def test_workers_need_no_copy(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]
