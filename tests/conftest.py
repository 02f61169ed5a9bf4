import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from colloquy.session import build_session
    session = build_session("local[4]", app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def talk(spark):
    """Build utterances from (speaker, text) pairs of one meeting."""
    def build(*turns, meeting="m"):
        return spark.createDataFrame(
            [(meeting, i, s, t, float(i), float(i + 1)) for i, (s, t) in enumerate(turns)],
            "meeting_id string, segment_index int, speaker string, text string, start_time double, end_time double")
    return build
