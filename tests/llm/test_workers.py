"""Queries run although the library is on the driver's path alone."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from commsim.session import local_session
spark = local_session("4", memory="3g", partitions=4, shared={shared!r})
import __spark_entry__ as contract

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(found=importlib.util.find_spec("commsim") is not None)

assert not spark.range(1).mapInPandas(importable, "id long, found boolean").first().found
queries = contract.queries()
for name in sorted(queries):
    if name.startswith("op") or name in ("pipeline", "affix_mine"):
        print(name, queries[name](spark, {sf_dir!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_workers_need_no_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"), sf_dir=SF_DIR)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split()) == 2 * 15
