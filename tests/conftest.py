import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import local_session  # noqa: E402

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, "tests",
        # Many tiny jobs: compiling each stage would take longer than running it.
        **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false",
           # As in sessions that others make: no plan may rely on this being off.
           "spark.sql.unionOutputPartitioning": "true",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    yield session
    session.stop()


@pytest.fixture
def files_of(spark):
    """Build a files table from {path: content} or {(project, path): content}."""

    def build(tree, project="app"):
        rows = [
            (*(key if isinstance(key, tuple) else (project, key)), content)
            for key, content in tree.items()
        ]
        return spark.createDataFrame(rows, "project string, rel_path string, content string")

    return build
