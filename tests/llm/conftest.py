import uuid

import pytest


@pytest.fixture
def narrow(spark):
    """Runs a function where the session sets 60 shuffle partitions and never joins small ones; gives its result and how many tasks it took."""
    asked = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}

    def run(f):
        group, context = uuid.uuid4().hex, spark.sparkContext
        context.setJobGroup(group, group)
        found, tracker = f(), context.statusTracker()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
        infos = [tracker.getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        return found, sum(i.numCompletedTasks for i in infos if i)

    for k, v in asked.items():
        spark.conf.set(k, v)
    yield run
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
