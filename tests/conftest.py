import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sessionlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log_root(tmp_path):
    """Writes session files: ``log_root({"2025/11/23/a.jsonl": [events]})``."""

    def write(files):
        for name, lines in files.items():
            path = tmp_path / "logs" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            text = lines if isinstance(lines, str) else "".join(
                (line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines
            )
            path.write_text(text, encoding="utf-8")
        return str(tmp_path / "logs")

    return write
