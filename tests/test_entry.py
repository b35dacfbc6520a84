"""The driver's entry points, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def test_import_without_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "seqwright"):
        (tmp_path / name).symlink_to(REPO / name)
    (tmp_path / "seqwright").unlink()
    (tmp_path / "seqwright").mkdir()
    for p in (REPO / "seqwright").iterdir():
        if p.name != "llm":
            (tmp_path / "seqwright" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
