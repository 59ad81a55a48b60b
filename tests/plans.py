"""Look into physical plans."""

import re


def plan_of(frame):
    """The physical plan as text; the final one if the frame has been run."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def exchanges(frame):
    return re.findall(r"Exchange (\w+)", plan_of(frame))
