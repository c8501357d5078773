"""The core stands without the training-data subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "quarryline"


def test_core_does_not_import_the_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+quarryline\.llm", path.read_text()), path


def test_no_local_checkpoints_or_cross_joins():
    for path in ROOT.rglob("*.py"):
        assert not re.search(r"\.(localCheckpoint|crossJoin)\(", path.read_text()), path


def test_everything_imports_without_a_session():
    """The entry is imported before any session exists."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT.parent, timeout=120).returncode == 0
