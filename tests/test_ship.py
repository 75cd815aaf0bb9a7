import subprocess
import sys

from spanloom import ship


def test_archive_can_be_imported(tmp_path):
    path = ship.archive(tmp_path / "spanloom.zip")
    code = "import spanloom.functions.text, spanloom.sources.files, spanloom.operators.report; assert '<article/>' in spanloom.operators.report.TEMPLATE; print(spanloom.functions.text.__file__)"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PYTHONPATH": f"{path}:" + ":".join(p for p in sys.path if "repo" not in p and p)})
    assert found.returncode == 0, found.stderr
    assert "spanloom.zip" in found.stdout


def test_workers_import_what_was_shipped(spark):
    ship.ship(spark)
    assert any("spanloom.zip" in f for f in spark.sparkContext.listFiles)
