import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark import session

    s = session.build("local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g",
                      spark_ui_showConsoleProgress="false",
                      spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted plain tuples of a DataFrame, floats rounded."""
    def get(df, *cols):
        out = []
        for r in df.select(*cols).collect() if cols else df.collect():
            out.append(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
        return sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))

    return get
