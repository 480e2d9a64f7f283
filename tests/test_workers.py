"""Python workers get the library's functions with the job: no copy of the package on their path."""

import os
import subprocess
import sys

from conftest import ROOT, SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})  # the driver's path only
import __spark_entry__ as e
from tessera.session import get_spark
s = get_spark("local[2]", 4)
for name in ("m2_quantile_normal", "a19_welch_pvalue"):
    print(name, e.queries()[name](s, {SMALL!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-1500:]
    assert out.stdout.count("\n") >= 2


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    import pytest
    from tessera.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
