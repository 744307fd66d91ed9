"""What zones a network has and which lanes are left out, case by case: streets and signals in, movements and reasons out."""

import pytest
from networks import crossing, plan, street, town, turn
from pyspark.sql import functions as F

from weftline.operators.zones import generate
from weftline.sources.network import read_network

NONE, NO_SIGNAL, RANGE = "no_outgoing_connection", "no_resolvable_program", "link_index_out_of_range"

#: name: parts of the network, zones as id and lanes, lanes left out with their reasons.
CASES = {
    "two lanes that go the same way share a zone": (
        [street("mill", 31, 33.5), plan("p", "GGr", "rrG"), crossing("market", "mill_0", "mill_1"), turn("mill_0", "r", "p", 0), turn("mill_1", "r", "p", 2)],
        [("mill_right", ["mill_0", "mill_1"])],
        [],
    ),
    "lanes of one street that go other ways don't": (
        [street("mill", 31, 33.5, 30), plan("p", "GGG"), crossing("market", "mill_0", "mill_1", "mill_2"), turn("mill_0", "r", "p", 0), turn("mill_1", "s", "p", 1), turn("mill_2", "s", "p", 2), turn("mill_2", "l", "p", 2)],
        [("mill_straight", ["mill_1"]), ("mill_straight+left", ["mill_2"]), ("mill_right", ["mill_0"])],
        [],
    ),
    "a signal that another crossing is named after": (
        [street("quay", 80), plan("both_crossings", "yG"), crossing("harbour", "quay_0"), turn("quay_0", "t", "both_crossings", 1)],
        [("quay_turn", ["quay_0"])],
        [],
    ),
    "a crossing with signals of unknown plan": (
        [street("quay", 80), crossing("harbour", "quay_0", kind="traffic_light_unregulated"), turn("quay_0", "s", "elsewhere", 0)],
        [],
        [("quay_0", NO_SIGNAL)],
    ),
    "turning right on red is a signal too": (
        [street("quay", 80), plan("p", "G"), crossing("harbour", "quay_0", kind="traffic_light_right_on_red"), turn("quay_0", "R", "p", 0)],
        [("quay_partial_right", ["quay_0"])],
        [],
    ),
    "a level crossing isn't": ([street("quay", 80), plan("p", "G"), crossing("rails", "quay_0", kind="rail_signal"), turn("quay_0", "s", "p", 0)], [], []),
    "nor is a crossing with right of way": ([street("quay", 80), plan("p", "G"), crossing("give", "quay_0", kind="priority"), turn("quay_0", "s", "p", 0)], [], []),
    "lanes that lead nowhere, and lanes that aren't there": (
        [street("dead", 12), plan("p", "G"), crossing("market", "gone_3", "dead_0")],
        [],
        [("gone_3", NONE), ("dead_0", NONE)],
    ),
    "footways are passed over, shared ways aren't": (
        [street("walk", 3, allow="pedestrian"), street("shared", 44, allow="bicycle pedestrian"), plan("p", "GG"), crossing("market", "walk_0", "shared_0"), turn("walk_0", "s", "p", 0), turn("shared_0", "s", "p", 1)],
        [("shared_straight", ["shared_0"])],
        [],
    ),
    "links beyond the shortest phase": (
        [street("hill", 60, 61), plan("p", "GGGG", "rr"), crossing("top", "hill_0", "hill_1"), turn("hill_0", "s", "p", 1), turn("hill_1", "s", "p", 2)],
        [("hill_straight", ["hill_0"])],
        [("hill_1", RANGE)],
    ),
    "a plan without phases takes any link but a negative one": (
        [street("hill", 60, 61), plan("p"), crossing("top", "hill_0", "hill_1"), turn("hill_0", "s", "p", 40), turn("hill_1", "s", "p", -2)],
        [("hill_straight", ["hill_0"])],
        [("hill_1", RANGE)],
    ),
    "states are counted by characters": (
        [street("hill", 60, 61), plan("p", "\U0001f7e2\U0001f534r"), crossing("top", "hill_0", "hill_1"), turn("hill_0", "s", "p", 2), turn("hill_1", "s", "p", 3)],
        [("hill_straight", ["hill_0"])],
        [("hill_1", RANGE)],
    ),
    "only controlled turns count, in their own order": (
        [street("hill", 60), plan("p", "GGG"), crossing("top", "hill_0"), turn("hill_0", "L", "p", 0), turn("hill_0", "T", "p", 1), turn("hill_0", "r", "p", 2), turn("hill_0", "s", "p", 7), turn("hill_0", "l"), turn("hill_0", "L", "p", 1)],
        [("hill_turn_left_hand+right+partial_left", ["hill_0"])],
        [],
    ),
    "turns from lanes that no street has": ([street("hill", 60), plan("p", "G"), crossing("top", "hill_0"), turn("hill_5", "s", "p", 0), turn("dale_0", "s", "p", 0)], [], [("hill_0", NONE)]),
    "ids that read alike are not one movement": (
        [street("a", 20), street("a_partial", 22), plan("p", "GG"), crossing("one", "a_0", "a_partial_0"), crossing("two", "a_0"), turn("a_0", "L", "p", 0), turn("a_partial_0", "l", "p", 1)],
        [("a_partial_left", ["a_0"]), ("a_partial_left", ["a_partial_0"]), ("a_partial_left", ["a_0"])],
        [],
    ),
}


@pytest.fixture
def read(spark, tmp_path):
    def read(*parts):
        path = tmp_path / "town.net.xml"
        path.write_text(town(*parts), encoding="utf-8")
        return read_network(spark, str(path))

    return read


def found(frames, cap=None):
    zones, left_out = generate(frames, cap)
    order = zones.orderBy("junction_pos", "from_edge", "dir_ords").collect()
    return [r.asDict(recursive=True) for r in order], [r.asDict() for r in left_out.orderBy("junction_pos", "inc_pos").collect()]


@pytest.mark.parametrize("case", CASES)
def test_case(read, case):
    parts, zones, left_out = CASES[case]
    got, out = found(read(*parts))
    assert [(z["zone_id"], [g["lane"] for g in z["entries"]]) for z in got] == zones
    assert [(d["lane_id"], d["reason"]) for d in out] == left_out


def test_where_a_zone_begins_and_ends(read):
    frames = read(street("long", 237.25), street("short", 18.5), plan("p", "GG"), crossing("end", "long_0", "short_0", at=(-8.5, 1200)), turn("long_0", "s", "p", 0), turn("short_0", "l", "p", 1))
    for cap, begins in ((None, (0.0, 0.0)), (50.0, (187.25, 0.0)), (18.5, (218.75, 0.0)), (18.25, (219.0, 0.25)), (0.0, (237.25, 18.5)), (-1.5, (238.75, 20.0)), (float("nan"), (0.0, 0.0)), (1e6, (0.0, 0.0))):
        zones, _ = found(frames, cap)
        assert tuple(z["entries"][0]["pos"] for z in zones) == begins, cap
        assert [z["exits"][0]["pos"] for z in zones] == [237.25, 18.5]
        assert all(z["icon"] == {"x": -8.5, "y": 1200.0, "z": 0.0} for z in zones)


def test_reports_name_the_first_bad_link_in_the_file(read):
    _, out = found(read(street("hill", 60), plan("p", "Gr"), plan("q", "G"), crossing("top", "hill_0"), turn("hill_0", "s", "unknown", 0), turn("hill_0", "s", "q", 3), turn("hill_0", "r", "p", 9)))
    assert [(d["program"], d["link_index"], d["message"]) for d in out] == [("q", 3, 'lane "hill_0" at junction "top" skipped: connection\'s linkIndex 3 is out of range for tlLogic "q"\'s phases')]
    _, out = found(read(street("hill", 60), crossing("top", "hill_0"), turn("hill_0")))
    assert [(d["program"], d["link_index"]) for d in out] == [(None, None)] and "signal-controlled" in out[0]["message"]


def test_repeated_names(read):
    """Of plans the first counts, of lanes the last."""
    zones, out = found(read(street("hill", 60), street("hill", 72), plan("p", "G", "rr"), plan("p", "GGG"), crossing("top", "hill_0"), turn("hill_0", "s", "p", 0), turn("hill_0", "l", "p", 1)))
    assert [(z["zone_id"], z["exits"][0]["pos"]) for z in zones] == [("hill_straight", 72.0)] and not out


def test_the_order_of_phases_changes_nothing(read):
    frames = read(street("hill", 60, 61), plan("p", "GrG", "rG", "yyyy"), crossing("top", "hill_0", "hill_1"), turn("hill_0", "s", "p", 1), turn("hill_1", "l", "p", 2))
    turned = frames.with_frames(programs=frames.programs.withColumn("phases", F.reverse("phases")))
    assert found(frames) == found(turned)


def test_unknown_turns_and_broken_files_are_errors(read, spark, tmp_path):
    with pytest.raises(Exception, match="unknown turn code"):
        found(read(street("hill", 60), plan("p", "G"), crossing("top", "hill_0"), turn("hill_0", "x", "p", 0)))
    broken = tmp_path / "broken.net.xml"
    broken.write_text('<net><edge id="hill"><lane id="hill_0" length="sixty"/></edge></net>')
    with pytest.raises(Exception):
        read_network(spark, str(broken)).lanes.collect()
