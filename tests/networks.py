"""Streets, signals and turns written as network files, in few words."""


def street(name, *lengths, allow=None, width=3.2, shapes=None, function=None):
    """An edge with a lane for each length."""
    use = f' allow="{allow}"' if allow is not None else ""
    kind = f' function="{function}"' if function else ""
    wide = f' width="{width}"' if width is not None else ""
    lanes = "".join(
        f'<lane id="{name}_{k}" index="{k}" speed="13.9" length="{length}"{wide} shape="{(shapes or [""] * 9)[k]}"{use}/>' for k, length in enumerate(lengths)
    )
    return f'<edge id="{name}"{kind}>{lanes}</edge>'


def crossing(name, *lanes, kind="traffic_light", at=(0, 0)):
    return f'<junction id="{name}" type="{kind}" x="{at[0]}" y="{at[1]}" incLanes="{" ".join(lanes)}" intLanes="" shape=""/>'


def turn(lane, way="s", signal=None, link=None):
    """A connection from a lane, written as street_index."""
    edge, _, index = lane.rpartition("_")
    control = (f' tl="{signal}"' if signal is not None else "") + (f' linkIndex="{link}"' if link is not None else "")
    return f'<connection from="{edge}" to="away" fromLane="{index}" toLane="0"{control} dir="{way}" state="M"/>'


def plan(name, *states):
    """A signal program with a phase for each state."""
    return f'<tlLogic id="{name}" type="static" programID="0" offset="0">{"".join(f"""<phase duration="25" state="{s}"/>""" for s in states)}</tlLogic>'


def town(*parts, offset="0,0", projection="!"):
    return f'<net version="1.16"><location netOffset="{offset}" convBoundary="0,0,9,9" origBoundary="0,0,9,9" projParameter="{projection}"/>{"".join(parts)}</net>'
