"""The driver's entry points, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as e

ROOT = e.__file__.rsplit("/", 1)[0]


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_optional_part():
    code = "import sys; import dagloom.plans.catalog, dagloom.kernel.runner, dagloom.sources.store, dagloom.streaming.live; assert not [m for m in sys.modules if m.startswith('dagloom.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['dagloom.llm'] = None; import __spark_entry__ as e; assert 'critical_path' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
