import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sunloom.session import ensure_checkpoint_dir, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "sunloom-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ensure_checkpoint_dir(session)
    return session


def rows_of(df, *order):
    """Rows as tuples in a stable order."""
    return sorted([tuple(r) for r in df.select(*order).collect()], key=repr)
