"""This package's behaviour when it is installed and submitted: settings
reach the operators, submitted Spark settings win, jobs start from any folder."""

import json
import os
import subprocess
import sys

import pyspark
import pytest

from corpusmill import session
from corpusmill.settings import Settings, load_settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_settings_sections_reach_their_fields(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({
        "model": {"max_length": 2048}, "training": {"num_train_epochs": 2, "seed": 7}, "dataset": {"think_token_start": "<t>", "think_token_end": "</t>"},
        "special_tokens": {"keep_tokens": ["<t>"], "remove_tokens": []}, "preprocessing": {"max_think_length": 9, "ensure_think_closure": False},
        "validation": {"think_token_coverage": 0.5, "check_think_token_balance": False}}))
    s = load_settings(str(path))
    assert s == Settings(max_length=2048, epochs=2, seed=7, think_start="<t>", think_end="</t>", keep_tokens=("<t>",), remove_tokens=(),
                         max_think_length=9, ensure_think_closure=False, think_coverage=0.5, check_think_balance=False)


@pytest.mark.parametrize("content", [None, "model: [unclosed"])
def test_unreadable_settings_leave_the_defaults(tmp_path, content):
    path = tmp_path / "s.yaml"
    if content is not None:
        path.write_text(content)
    assert load_settings(str(path)) == Settings()


def test_submitted_settings_survive(tmp_path):
    """What spark-submit passes is kept over the package's defaults."""
    script = tmp_path / "job.py"
    script.write_text(
        "from corpusmill.session import get_session; s = get_session(shuffle_partitions=3); c = s.sparkContext.getConf()\n"
        "print('GOT', c.get('spark.driver.memory'), c.get('spark.sql.adaptive.autoBroadcastJoinThreshold'), c.get('spark.driver.host'),"
        " c.get('spark.app.name'), s.conf.get('spark.sql.shuffle.partitions'))\n")
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    done = subprocess.run(
        [submit, "--master", "local[1]", "--driver-memory", "1g", "--name", "mine", "--conf", "spark.driver.host=localhost",
         "--conf", "spark.sql.adaptive.autoBroadcastJoinThreshold=20MB", str(script)], cwd=tmp_path,
        env=os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert "GOT 1g 20MB localhost mine 3" in done.stdout, done.stderr[-2000:]


def test_local_masters():
    assert session.is_local("local") and session.is_local("local[8]")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn") and not session.is_local("spark://h:7077")


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "x"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)
    monkeypatch.setattr(session, "_context", lambda s: Context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session)


@pytest.mark.parametrize("job", ["rewrite", "prepare", "report"])
def test_jobs_start_outside_the_repository(tmp_path, job):
    """As a submitted script with the package on the path only."""
    done = subprocess.run([sys.executable, f"{ROOT}/corpusmill/jobs/{job}.py", "--help"], cwd=tmp_path,
                          env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "--input" in done.stdout
