import pytest

from fieldweave.llm.common import share_package


@pytest.fixture(autouse=True)
def shared(spark):
    share_package(spark)
