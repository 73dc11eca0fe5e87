"""The rest of the library does not need the llm folders or the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_llm(tmp_path):
    for name in ("vecloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "vecloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_report' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "vecloom")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "vecloom.llm" not in open(os.path.join(folder, name)).read().replace('"""', "")


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from vecloom.session import local_session; s = local_session(2, '1g'); "
        "assert e.queries()['exact_topk_cosine'](s, '/root/testdata/sf0.001').count() > 0"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=200, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
