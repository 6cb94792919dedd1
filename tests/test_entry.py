import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 45


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and got.columns[:2] == ["id", "title"]


def test_the_rest_imports_without_the_corpus_folders(tmp_path):
    for p in ("__spark_entry__.py", "strandline"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "strandline/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
    n, corpus, sql = said.stdout.split()
    assert int(n) >= 45 and corpus == "False" and int(sql) >= 40
    subprocess.run(["cp", "-r", str(ROOT / "tests"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tests/llm")], check=True)
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)}
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert found.returncode == 0 and "error" not in found.stdout.lower().rsplit("\n", 2)[-2], found.stdout[-2000:]
    assert not [p for p in (ROOT / "strandline").rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text()]
