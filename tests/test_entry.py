import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_oracles():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1


def test_rest_works_without_the_removable_parts(tmp_path):
    for part in ("skyloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, part), tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/skyloom/llm"], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-1] == "False", out.stderr
