from __future__ import annotations

import os
from pathlib import Path

import pytest


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def worker_path():
    """Python workers import the package too."""
    root = str(Path(__file__).resolve().parents[2])
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
