"""The shared folder and the package given to workers."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from visitline import session as S


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def fake(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            S.shared_folder(fake(master))
        assert S.shared_folder(fake(master, **{"spark.checkpoint.dir": "/shared/x/"})) == "/shared/x"
    one = fake("local[4]")
    assert S.shared_folder(one) == S.shared_folder(one)


def test_materialized_frames_can_be_released(spark):
    frame = S.materialize(spark.range(5), "t")
    assert frame.count() == 5
    S.release(frame)
    assert not Path(frame._visitline_folder).exists()


def test_workers_find_the_package_from_another_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "a.csv").write_text("RID,DX\n1,CN\n")
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from visitline.session import build_session\nfrom visitline.sources.inventory import scan_folder\n"
        "spark = build_session('t', 'local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='2')\n"
        f"print('rows', scan_folder(spark, {str(tmp_path)!r}).first()['rows'])\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
