"""Every query runs where the package is known to the driver alone."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from casemill.session import build_session

spark = build_session("elsewhere", "local[2]", **{{
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {shared!r},
}})
spark.sparkContext.setLogLevel("OFF")
for name, run in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print(name, run(spark, {data!r}).count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, data=DATA, shared=str(tmp_path / "shared")))
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False
    )
    names = [line.split()[0] for line in done.stdout.splitlines() if line.startswith(("op", "pipeline"))]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(names) == 14 and "op6_decontaminate" in names and "pipeline" in names
