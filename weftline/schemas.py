"""Shapes of the network description, and the fixed vocabularies of the format."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Turn codes of connections with their names, in the order in
# which the directions of one movement are listed.
DIRECTIONS = [
    ("s", "straight"),
    ("t", "turn"),
    ("T", "turn_left_hand"),
    ("l", "left"),
    ("r", "right"),
    ("L", "partial_left"),
    ("R", "partial_right"),
]
DIRECTION_LABELS = [label for _, label in DIRECTIONS]

# Junction kinds whose vehicles wait for a road signal.
SIGNAL_KINDS = ["traffic_light", "traffic_light_unregulated", "traffic_light_right_on_red"]

# The texts in which lanes left out are reported. The places of the
# first are lane, junction and reason; of the last, link index and program.
SKIPPED_TEXT = 'lane "%s" at junction "%s" skipped: %s'
NO_OUTGOING_TEXT = "no outgoing connection in the network at all"
NO_PROGRAM_TEXT = "none of its connections are signal-controlled (no `tl` naming a program this file defines)"
OUT_OF_RANGE_TEXT = "connection's linkIndex %d is out of range for tlLogic \"%s\"'s phases"

PEDESTRIAN = "pedestrian"
DEFAULT_LANE_WIDTH_M = 3.2

# The attributes that are read of each element, and the parts of a network file that are
# read. Explicit, so that a single child is an array too.
LOCATION = "_netOffset string, _projParameter string"
EDGE = "_id string, _function string"
LANE = "_id string, _index int, _speed double, _length double, _width double, _allow string, _disallow string, _shape string"
PROGRAM = "_id string, _type string, _programID string, _offset double"
PHASE = "_duration double, _state string"
JUNCTION = "_id string, _type string, _x double, _y double, _z double, _incLanes string, _intLanes string, _shape string"
CONNECTION = "_from string, _to string, _fromLane int, _toLane int, _via string, _tl string, _linkIndex int, _dir string, _state string, _pass boolean, _keepClear boolean"


def _struct(fields: str) -> str:
    return f"struct<{', '.join(': '.join(f.split()) for f in fields.split(', '))}>"


_EDGE_WITH_LANES = _struct(EDGE)[:-1] + f", lane: array<{_struct(LANE)}>>"
_PROGRAM_WITH_PHASES = _struct(PROGRAM)[:-1] + f", phase: array<{_struct(PHASE)}>>"
NET = f"location {_struct(LOCATION)}, edge array<{_EDGE_WITH_LANES}>, tlLogic array<{_PROGRAM_WITH_PHASES}>, junction array<{_struct(JUNCTION)}>, connection array<{_struct(CONNECTION)}>"


@dataclass(frozen=True)
class NetworkFrames:
    """Networks as tables. Every table has a column net, which names the network; ids are unique, and looked up, within one network only. Each *_pos column is the place in the file.

    location: net_x, net_y, proj (null: not georeferenced); one row for a network
    lanes: edge_pos, lane_pos, edge_id, lane_id, lane_index, length_m, width_m, allow, shape
    junctions: junction_pos, junction_id, kind, x, y, z
    inc_lanes: junction_pos, inc_pos, lane_id
    connections: conn_pos, from_edge, from_lane, dir_ord, tl, link_index
    programs: program_pos, tl, phases (array of struct duration, state)
    """

    location: DataFrame
    lanes: DataFrame
    junctions: DataFrame
    inc_lanes: DataFrame
    connections: DataFrame
    programs: DataFrame

    def with_frames(self, **frames: DataFrame) -> NetworkFrames:
        return replace(self, **frames)
