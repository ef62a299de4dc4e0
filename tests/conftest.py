"""One local session for all tests, and the driver's tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallybook.session import session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    started = session(
        "local[*]",
        8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    started.sparkContext.setLogLevel("ERROR")
    yield started
    started.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


@pytest.fixture
def rows_of():
    """A result's rows as a sorted list of tuples, nulls first."""

    def collect(frame, *columns):
        chosen = frame.select(*columns) if columns else frame
        return sorted(
            (tuple(row) for row in chosen.collect()),
            key=lambda row: tuple((value is not None, value) for value in row),
        )

    return collect


def _nodes(node):
    """A finished plan's operators, through adaptive stages."""
    yield node
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        inner = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        inner = [node.plan()]
    else:
        children = node.children()
        inner = [children.apply(place) for place in range(children.size())]
    for child in inner:
        yield from _nodes(child)


@pytest.fixture
def shuffles_of():
    """Run a result; its shuffles as (partitioning, rows written, bytes per partition), last first."""

    def shuffles(frame):
        frame.collect()
        stages = (
            node
            for node in _nodes(frame._jdf.queryExecution().executedPlan())
            if node.getClass().getSimpleName() == "ShuffleQueryStageExec"
        )
        return [
            (
                stage.shuffle().outputPartitioning().toString(),
                stage.shuffle().metrics().apply("shuffleRecordsWritten").value(),
                list(stage.mapStats().get().bytesByPartitionId()),
            )
            for stage in stages
            if stage.mapStats().isDefined()
        ]

    return shuffles
