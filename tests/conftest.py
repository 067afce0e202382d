import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples with rounded floats."""
    def collect(df, *cols, digits=9):
        def tidy(v):
            return round(v, digits) + 0.0 if isinstance(v, float) else v
        out = [tuple(tidy(r[c]) for c in (cols or df.columns)) for r in df.collect()]
        return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))
    return collect
