"""The driver contract."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "symbol" and df.count() > 0


def test_rest_works_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("propago.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith(("op1_", "pipeline")) for n in e.queries()) and len(e.queries()) > 60
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
