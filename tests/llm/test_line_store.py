"""Where the runs of line hashes lie, and that none is left."""

import pathlib

import pytest

from tapeloom.llm import line_runs
from tapeloom.llm.common import shared_dir

from .cases import write


def left(spark):
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    files = [str(p) for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("tapeloom-runs-*/*")]
    warehouse = pathlib.Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    return tables + files + ([str(p) for p in warehouse.glob("line_run_*")] if warehouse.exists() else [])


def test_runs_lie_in_the_shared_folder_and_go(spark, tmp_path, monkeypatch):
    folder, seen, whole = write(spark, tmp_path), [], line_runs.LineRuns.add

    def adding(self, lines):
        whole(self, lines)
        seen.append(left(spark))

    monkeypatch.setattr(line_runs.LineRuns, "add", adding)
    rows = line_runs.op9_line_runs(spark, folder).collect()
    assert rows and left(spark) == []
    at = shared_dir(spark).removeprefix("file://")
    assert len(seen) > 1 and all(x and all(p.startswith(("line_run_", at)) for p in x) for x in seen)


def test_runs_go_where_a_batch_fails(spark, tmp_path, monkeypatch):
    folder, whole, n = write(spark, tmp_path), line_runs.LineRuns.add, []

    def adding(self, lines):
        whole(self, lines)
        n.append(1)
        if len(n) == 2:
            raise RuntimeError("the batch is lost")

    monkeypatch.setattr(line_runs.LineRuns, "add", adding)
    with pytest.raises(RuntimeError, match="the batch is lost"):
        line_runs.op9_line_runs(spark, folder).collect()
    assert left(spark) == []
