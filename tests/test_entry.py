"""The driver's contract, with and without the text operators."""

import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent


def test_names_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 40


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_text_operators(tmp_path):
    (tmp_path / "evoked_spark").mkdir()
    for p in (ROOT / "evoked_spark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "evoked_spark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

    # a package that text operators need and don't find isn't passed over
    (tmp_path / "evoked_spark" / "llm").mkdir()
    (tmp_path / "evoked_spark" / "llm" / "__init__.py").write_text("import no_such_package\n")
    failed = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert failed.returncode and "no_such_package" in failed.stderr
