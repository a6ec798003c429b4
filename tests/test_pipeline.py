"""The whole run over the test records, and again under another clock."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

RUN = """
import json, sys
sys.path.insert(0, {root!r})
from dataclasses import replace
from kerbwatch.config import BoostSettings
from kerbwatch.plans.pipeline import run_pipeline
from kerbwatch.session import build_session
from kerbwatch.sources.events_fixture import event_records, fixture_settings
spark = build_session("local[4]", 4)
spark.sparkContext.setLogLevel("ERROR")
short = BoostSettings("hotspot", 1.0, 2, 0.2, 4, 40, 2.0, 3.0)
s = fixture_settings()
s = replace(s, model=replace(s.model, hotspot=short, impact_members=(replace(short, name="one"),), calibration_windows=0))
out = {out!r}
result = run_pipeline(spark, event_records(spark, "/root/testdata/sf0.001"), out, s)
print("PLAN", result.patrol_plan.count(), result.predictions.count())
"""


def folder_json(path: Path) -> list[dict]:
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_run_pipeline_under_any_clock(tmp_path, zone):
    done = subprocess.run(
        [sys.executable, "-c", RUN.format(root=str(ROOT), out=str(tmp_path))],
        env={**os.environ, "TZ": zone}, capture_output=True, text=True, timeout=900,
    )
    assert "PLAN 8 " in done.stdout, done.stderr[-1500:]
    artifacts = tmp_path / "artifacts"
    (summary,) = folder_json(artifacts / "data_summary")
    assert (summary["source_rows"], summary["clean_rows"], summary["active_model_zones"]) == (1028, 817, 25)
    assert summary["date_min"].startswith("2024-01-01 ") and summary["date_min"].endswith("+00:00")
    assert summary["default_demo_window"].endswith("+00:00")
    (manifest,) = folder_json(artifacts / "run_manifest")
    assert set(manifest["artifacts"]) == {p.name for p in artifacts.iterdir()} - {"run_manifest"}
    (metadata,) = folder_json(tmp_path / "models" / "metadata")
    assert metadata["default_demo_window"] == summary["default_demo_window"]
    (coverage,) = folder_json(artifacts / "evaluation_coverage")
    assert coverage["rows"] == 2100 and coverage["zones"] == 25
    assert len(folder_json(artifacts / "metrics")) > 50
