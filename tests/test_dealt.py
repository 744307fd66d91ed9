"""How rows are dealt to tasks."""

import pytest
from networks import crossing, plan, street, town, turn
from pyspark.sql import functions as F

from weftline.operators import resolve
from weftline.plans import catalog
from weftline.sources.network import read_network

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def silent(spark, tmp_path):
    """A network of 40 lanes with a connection each, of which one has a signal."""
    parts = [street(f"e{k}", 50) for k in range(40)]
    turns = [turn(f"e{k}_0", signal="S" if k == 7 else None, link=0) for k in range(40)]
    (tmp_path / "a.net.xml").write_text(town(*parts, plan("S", "Gr"), crossing("J", *(f"e{k}_0" for k in range(40))), *turns))
    return read_network(spark, str(tmp_path / "a.net.xml"))


def test_connections_without_a_signal_do_not_meet_in_one_task(spark, silent):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = resolve.connection_status(silent).select("tl", "status", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sorted((r["tl"] or "", r["status"]) for r in rows) == [("", "none")] * 39 + [("S", "ok")]
    assert len({r["task"] for r in rows if r["tl"] is None}) == 4


@pytest.mark.parametrize("build", [lambda net: resolve.connection_status(net), lambda net: resolve.lane_keys(net), lambda net: net.lanes], ids=["status", "keys", "lanes"])
def test_tasks_are_not_put_together(spark, build):
    """Tables far smaller than what Spark deals to one task stay in as many as there are shuffle partitions."""
    rows = build(catalog.star_network(spark, DATA)).select(F.spark_partition_id().alias("task"))
    assert rows.distinct().count() == 4
