import pytest


@pytest.fixture(scope="session", autouse=True)
def needs_llm():
    pytest.importorskip("knotwork.llm")
