"""Scratch folders belong to the application that made them."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from tessera.session import get_session, scratch_dir
spark = get_session("local[1]", 2)
spark.range(5).write.parquet(scratch_dir(spark, "t"))
print("AT", scratch_dir(spark, "u").rsplit("/", 1)[0])
spark.stop()
"""


def test_scratch_goes_with_its_application():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CODE, root], capture_output=True, text=True, timeout=120).stdout
    place = out.rsplit("AT ", 1)[1].strip().removeprefix("file:")
    assert os.path.basename(place).startswith("tessera-scratch-") and not os.path.exists(place)
