from __future__ import annotations

from types import SimpleNamespace

import pytest

from liftgrid.session import checkpoint_dir


def test_only_one_machine_gets_a_private_folder():
    """Elsewhere executors would write where the others cannot read."""
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)
