import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def raw(tmp_path):
    """A raw folder and a function that puts files into it."""
    folder = tmp_path / "raw"
    folder.mkdir()

    def put(name, text, **options):
        path = folder / name
        path.write_text(text, encoding="utf-8", newline="", **options)
        return str(path)

    put.folder = str(folder)
    return put
