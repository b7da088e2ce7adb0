import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    session.sparkContext.setLogLevel("ERROR")
    return session
