"""Driver contract: entry() runs, every query has a callable, oracle keys exist."""
import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"rule_id", "severity", "n_findings"}
    assert df.count() == 7


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_needs_no_session():
    import subprocess
    import sys
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_every_module_is_collected():
    """All tests are found from the repository's root, also those beside another folder's conftest."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-m", "pytest", "tests/", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
    for folder, _, names in os.walk(os.path.join(root, "tests")):
        for name in names:
            if name.startswith("test_") and name.endswith(".py"):
                assert f"{os.path.relpath(os.path.join(folder, name), root)}::" in run.stdout, name
