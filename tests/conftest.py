import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    s = local_session(4, 4)
    yield s
    s.stop()


BLOCKS = "id long, envelope_date string, sender string, text string, src_idx int, ingested_at timestamp"


@pytest.fixture(scope="session")
def blocks_of(spark):
    """Rows (id, envelope_date, sender, text[, src_idx]) as a table of blocks."""
    from datetime import datetime

    def make(rows, extra=""):
        rows = [(*r, *([0] if len(r) == 4 else []), datetime(2026, 3, 1)) for r in rows]
        return spark.createDataFrame(rows, BLOCKS)

    return make
