"""Importing the package runs nothing (no session, no output)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_have_no_side_effects():
    code = ("import pkgutil, importlib, tierspark\n"
            "mods = [m.name for m in pkgutil.walk_packages(tierspark.__path__, 'tierspark.')\n"
            "        if not m.name.endswith('__main__')]\n"
            "[importlib.import_module(m) for m in mods]\n"
            "import __spark_entry__\n"
            "from pyspark import SparkContext\n"
            "assert SparkContext._active_spark_context is None\n"
            "print(len(mods))\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                         timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip().isdigit()
