import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "tidemark-tests")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s
