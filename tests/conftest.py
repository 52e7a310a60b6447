import pytest

from strandlake.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="64")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
