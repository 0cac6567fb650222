import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
from folioforge.session import Scratch, local_session, stage
s = local_session(2, 2, "1g")
kept = stage(s.range(10))
with Scratch() as tmp:
    a = tmp(s.range(5))
    b = tmp(a.selectExpr("id + 1 AS id"))
    tmp.drop(a)
    n = b.count()
import os
assert n == 5 and kept.count() == 10 and len([x for x in os.listdir("{0}/folioforge") if x[0] != "."]) == 1
s.stop()
"""


def test_shared_folder_is_empty_after_the_session(tmp_path):
    """Stages go with their operator; what a result still reads goes when the driver ends, also if its session was stopped."""
    done = subprocess.run([sys.executable, "-c", RUN.format(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file://{tmp_path} pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list((tmp_path / "folioforge").glob("*"))
