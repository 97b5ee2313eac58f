import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    from larkspur.llm.common import scratch_dir

    scratch_dir(spark)
