import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    for path in ROOT.glob("ledgerweave/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "ledgerweave.llm" not in path.read_text(), path


def test_the_entry_works_without_them(tmp_path):
    for name in ("ledgerweave", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'daily_cost' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_no_local_checkpoints():
    for path in [*ROOT.glob("ledgerweave/**/*.py"), ROOT / "__spark_entry__.py"]:
        assert "localCheckpoint" not in path.read_text(), path


def test_only_the_entry_guards_imports():
    for path in ROOT.glob("ledgerweave/**/*.py"):
        assert not re.search(r"except (ImportError|ModuleNotFoundError)", path.read_text()), path
