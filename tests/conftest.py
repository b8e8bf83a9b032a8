import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
