import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "vec_id", "label", "score", "rank"] and df.count() > 0


def test_imports_without_the_optional_subpackage():
    """A process that can't import the training-data operators still has all other queries."""
    code = """
import sys
class Refuse:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("chronolex.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Refuse())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 250 and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_it():
    for path in (ROOT / "chronolex").rglob("*.py"):
        if "llm" not in path.parts:
            assert "chronolex.llm" not in path.read_text(encoding="utf-8"), path
