"""A network read as a stream of tags by several tasks, against the same file read as one row."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from networks import crossing, plan, street, town, turn
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators.zones import generate
from weftline.plans import catalog
from weftline.sources.netfiles import in_groups, write_networks
from weftline.sources.network import placed_tags, read_large_network, read_network, scan_splits, scan_tags, tables_of_tags

TABLES = ("location", "lanes", "junctions", "inc_lanes", "connections", "programs")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(spark, path):
    one, other = read_network(spark, str(path)), read_large_network(spark, str(path))
    for table in TABLES:
        a, b = getattr(one, table), getattr(other, table)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), table
    return one, other


def city(rng, n):
    """Streets with up to nine lanes, so that splits fall within them, and comments that hold tags."""
    parts = []
    for k in range(n):
        lanes = [rng.randrange(5, 90) + rng.random() for _ in range(rng.randrange(1, 10))]
        parts.append(street(f"s{k}é", *lanes, allow=rng.choice([None, "pedestrian", "bus &gt; tram"]), width=rng.choice([3.2, None]), function=rng.choice([None, "internal"])))
        if rng.random() < 0.1:
            parts.append(rng.choice(["<!-- nothing -->", '<!-- <edge id="no"><lane id="no_0" index="0" length="1"/></edge> -->', "<!-- " + "<junction/> " * 400 + "-->", '<edge id="empty"/>', '<roundabout nodes="a" edges="b"/>', "\n\t  \n"]))
    parts += [plan(f"p{k}", *("Gr" * rng.randrange(1, 4) for _ in range(rng.randrange(4)))) for k in range(n // 4)]
    parts += [crossing(f"x{k}", f"s{k}é_0", f"s{k}é_1", "", kind=rng.choice(["traffic_light", "priority"]), at=(k, -k)) for k in range(n)]
    parts += [turn(f"s{k}é_{j}", rng.choice("stlrLRT"), f"p{rng.randrange(n // 3)}", rng.randrange(5)) for k in range(n) for j in range(2)]
    return town(*parts, offset="5,-7.5", projection="+proj=utm +zone=33").replace("><", rng.choice(["><", ">\n  <", "> <"]))


@pytest.mark.parametrize("seed", range(3))
def test_tags_are_put_together_again(spark, tmp_path, small_splits, seed):
    path = tmp_path / "city.net.xml"
    path.write_text('<?xml version="1.0" encoding="UTF-8"?>\n<!-- made for\n a <test> -->\n' + city(random.Random(seed), 60), encoding="utf-8")
    one, other = same(spark, path)
    assert scan_tags(spark, str(path)).select("block").distinct().count() > 5
    cap = 30.0
    (zones, out), (zones_too, out_too) = generate(one, cap), generate(other, cap)
    assert zones.count() > 5 and sorted(map(repr, zones.collect())) == sorted(map(repr, zones_too.select(*zones.columns).collect()))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, out_too.select(*out.columns).collect()))


def test_staged_tags_are_parsed_once(spark, tmp_path, small_splits):
    """Tables of staged tags are the same, and neither parse a tag again nor number rows by sorting them."""
    path = tmp_path / "city.net.xml"
    path.write_text(city(random.Random(7), 40), encoding="utf-8")
    tags = scan_splits(spark, str(path))
    tags.write.partitionBy("kind").parquet(str(tmp_path / "staged"))
    one, other = read_network(spark, str(path)), tables_of_tags(placed_tags(spark.read.schema(tags.schema).parquet(str(tmp_path / "staged"))))
    for table in TABLES:
        a, b = getattr(one, table), getattr(other, table)
        plan = b._jdf.queryExecution().optimizedPlan().toString()
        assert "xml" not in plan.lower() and "row_number" not in plan, table
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), table


def test_signs_in_values_are_written_back(spark, tmp_path):
    name = "a&amp;amp;&lt;b&gt; &quot;c&quot;&#9;d&#10;e"
    (tmp_path / "a.net.xml").write_text(town(street(name, 5), crossing(name, f"{name}_0"), turn(f"{name}_0", signal=name, link=0), plan(name, "G")), encoding="utf-8")
    frames = read_network(spark, str(tmp_path / "a.net.xml"))
    write_networks(frames.with_frames(**{t: getattr(frames, t).withColumn("net", F.lit("0")) for t in TABLES}), str(tmp_path / "again"))
    for again in (read_network(spark, str(tmp_path / "again")), read_large_network(spark, str(tmp_path / "again"))):
        assert [r["edge_id"] for r in again.lanes.collect()] == ['a&amp;<b> "c"\td\ne']
        assert again.connections.first()["tl"] == again.programs.first()["tl"] == again.junctions.first()["junction_id"] == 'a&amp;<b> "c"\td\ne'


def test_several_files(spark, tmp_path, small_splits):
    (tmp_path / "nets").mkdir()
    for k in range(3):
        (tmp_path / "nets" / f"{k}.net.xml").write_text(city(random.Random(k), 12 + 9 * k), encoding="utf-8")
    same(spark, tmp_path / "nets")


def test_networks_written_back(spark, tmp_path):
    """Tables written as files and read again are the same, names of the networks aside."""
    (tmp_path / "nets").mkdir()
    for k in range(2):
        text = city(random.Random(10 + k), 15).replace('<edge id="empty"/>', "")
        (tmp_path / "nets" / f"{k}.net.xml").write_text(text, encoding="utf-8")
    frames = read_network(spark, str(tmp_path / "nets"))
    named = frames.with_frames(**{t: getattr(frames, t).withColumn("net", F.regexp_extract("net", "([0-9])[.]net", 1)) for t in TABLES})
    write_networks(named, str(tmp_path / "again"))
    again = read_network(spark, str(tmp_path / "again"))
    for table in TABLES:
        a, b = getattr(named, table), getattr(again, table).withColumn("net", F.regexp_extract("net", "net=([0-9])/", 1))
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), table


def test_one_group_of_networks_lies_on_disk(spark, monkeypatch):
    """Files of a few networks at a time; these and all shuffles behind them are gone when zones are made of the staged tags."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    def write(net, folder):
        write_networks(net, folder)
        folders.append(Path(urlparse(folder).path))
        written.append(len(list(folders[-1].glob("net=*"))))

    def keep(frame, kept=catalog.kept):
        end = time.time() + 20
        while (left := shuffles() - before) and time.time() < end:  # Spark doesn't wait until they are removed
            time.sleep(0.1)
        lying.append((len(left), [f for f in folders if f.exists()]))
        return kept(frame)

    monkeypatch.setattr(catalog, "write_networks", write)
    monkeypatch.setattr(catalog, "kept", keep)
    monkeypatch.setattr(catalog, "in_groups", lambda net: in_groups(net, few=3000))
    before, folders, written, lying = shuffles(), [], [], []
    zones = catalog.queries()["zones_from_files"](spark, "/root/testdata/sf0.001")
    assert lying == [(0, [])] * len(written) and len(written) > 1
    assert sum(written) == 25 and max(written) < 25
    assert zones.select("net").distinct().count() > 20 and zones.count() == zones.select("junction_id", "zone_id").distinct().count()


def test_documents_of_a_large_network(spark, tmp_path, small_splits, monkeypatch):
    """The command line writes the same documents, whichever way it reads."""
    path = tmp_path / "city.net.xml"
    path.write_text(city(random.Random(4), 40), encoding="utf-8")
    documents = []
    for limit in (cli.LARGE_BYTES, 0):
        monkeypatch.setattr(cli, "LARGE_BYTES", limit)
        cli.run(cli.Config(path, tmp_path / f"{limit}.xml", 25.0, tmp_path / f"{limit}.json"), spark)
        documents.append([(tmp_path / f"{limit}.{end}").read_text(encoding="utf-8") for end in ("xml", "json")])
    assert documents[0] == documents[1] and documents[0][0].count("<e3Detector") > 5


def test_what_is_an_error(spark, tmp_path):
    path = tmp_path / "t.net.xml"
    path.write_text(town(street("a", 5)).replace('length="5"', 'length="five"'))
    with pytest.raises(Exception):
        read_large_network(spark, str(path)).lanes.collect()
    path.write_text(town(street("a", 5), "<param><![CDATA[ <edge/> ]]></param>"))
    with pytest.raises(Exception, match="CDATA"):
        read_large_network(spark, str(path)).lanes.collect()
    path.write_text('<net><edge id="a"/></net>')
    same(spark, path)
