import random

import numpy as np
import pytest

from larkspur.llm import components


def graph():
    """Links with hubs, long chains, loops, repeats, negative numbers and nulls, and the smallest node reachable from each node."""
    r = random.Random(21)
    links = [(0, i) for i in range(1, 300)] + [(9000, i) for i in range(290, 320)] + [(i + 1, i) for i in range(6000, 6300)]
    links += [(r.randrange(7000, 7200), r.randrange(7000, 7200)) for _ in range(120)] + [(-(1 << 63), 8000), (8000, (1 << 63) - 1), (-5, -7)] + [(r.randrange(50), r.randrange(50)) for _ in range(500)]
    links += links[::3]
    r.shuffle(links)
    lowest = {x: x for a, b in links if a != b for x in (a, b)}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a != b and lowest[a] != lowest[b]:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
                moved = True
    return [*links, (None, 1), (1, None), (None, None), (4444, 4444)], lowest


def test_lowest_reachable_equals_brute_force():
    links, lowest = graph()
    own = [x for x in links if None not in x and x[0] != x[1]]
    nodes, low = components.lowest_reachable(*np.array(own, np.int64).T)
    assert dict(zip(nodes.tolist(), low.tolist())) == lowest
    assert not len(components.lowest_reachable(np.zeros(0, np.int64), np.zeros(0, np.int64))[0])


@pytest.mark.parametrize("most", [1 << 20, 200, 10])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    """Whether one task can hold all links, or the tasks' forests go through star steps, with blocks that shrink and that do not."""
    monkeypatch.setattr(components, "LINKS", most)
    links, lowest = graph()
    stars, own = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a: stars.append(1) or own(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(lowest) and {x.node: x.component for x in found} == lowest
    assert bool(stars) == (most < 1 << 20)


def test_few_links_in_many_partitions_take_few_tasks(spark):
    """Every task is written to the event log and leaves files, so rounds over many nearly empty partitions fill the disk."""
    parts = 24
    links = spark.range(0, 400, 1, parts).selectExpr("id as a", "id + 1 as b").checkpoint()
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("components-tasks", "")
    try:
        found = components.connected_components(links).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 401 and {x.component for x in found} == {0}
    stages = {s for j in tracker.getJobIdsForGroup("components-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < tasks <= 4 * parts
