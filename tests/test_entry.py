"""The registered queries, with and without the text operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from versograph.plans import queries

ROOT = Path(__file__).resolve().parent.parent


def test_every_archive_query_has_sql():
    assert len(queries.QUERIES) >= 70 and set(queries.QUERIES) == set(queries.ORACLES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_text_operators(tmp_path):
    for name in ("versograph", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (ROOT / "versograph").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "versograph" / p.name).symlink_to(p)
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p and {str(ROOT)!r} != p]; import __spark_entry__ as e; q = e.queries(); assert 'vm_all' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q, list(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_names_a_module_that_the_text_operators_miss():
    code = "import sys, warnings; sys.modules['ahocorasick'] = None; import __spark_entry__ as e\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always'); q = e.queries()\nassert 'vm_all' in q and 'pipeline' not in q; assert any('ahocorasick' in str(x.message) for x in w) or not __import__('os').path.isdir('versograph/llm')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_flagship_query(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        assert __spark_entry__.entry(spark).columns == ["s", "p", "o"]
