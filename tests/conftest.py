import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import checkpoint_root, get_session
    s = get_session("local[4]", app="corpusmill-tests", shuffle_partitions=4)
    checkpoint_root(s)
    yield s


@pytest.fixture()
def tmp_dir(spark):
    from corpusmill.session import scratch_path
    return scratch_path(spark, "test")
