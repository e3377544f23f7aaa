import pytest


@pytest.fixture(scope="session")
def llm_spark(spark):
    from tidelog.llm.common import job_conf
    job_conf(spark)
    return spark
