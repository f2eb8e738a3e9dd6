import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import documents, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
