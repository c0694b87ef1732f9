import pytest
from llm_rows import COLUMNS, document_rows

from lagcast.llm.common import prepared


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def documents(llm):
    return llm.createDataFrame(document_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(llm):
    return llm.createDataFrame([], COLUMNS)
