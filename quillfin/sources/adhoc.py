"""One SELECT of somebody else's: its plan is checked before it runs, and it is stopped after a time."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Rows, characters and seconds that an answer may take.
MAX_ROWS = 200
MAX_CHARS = 40_000
MAX_SECONDS = 10.0
GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class Refused(ValueError):
    """The statement does more than read."""


@dataclass
class Answer:
    content: str
    rows: int = 0
    truncated: bool = False
    error: bool = False


def _commands(plan, kinds) -> list[str]:
    """Names of the nodes of a parsed plan that would do something."""
    own = [plan.nodeName()] if any(k.isInstance(plan) for k in kinds) else []
    children = plan.children()
    for i in range(children.size()):
        own += _commands(children.apply(i), kinds)
    return own


def checked(spark: SparkSession, sql: str) -> DataFrame:
    """The statement's frame, if its parsed plan has no command or write in it. Nothing of a refused one runs."""
    jvm = spark.sparkContext._jvm
    base = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [jvm.java.lang.Class.forName(base + k) for k in ("Command", "ParsedStatement", "CompoundPlanStatement")]
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    if found := _commands(plan, kinds):
        raise Refused(f"not allowed: a single SELECT only, not {found[0]}")
    return spark.sql(sql.strip().rstrip(";"))


def answer(spark: SparkSession, sql: str, rows: int = MAX_ROWS, chars: int = MAX_CHARS, seconds: float = MAX_SECONDS) -> Answer:
    """JSON of columns and rows: at most ``rows`` rows and ``chars`` characters, else ``truncated``; an error's text for what is refused, fails or takes over ``seconds``.

    The bounds are the feature. Jobs run in a group of their own, so only they are cancelled; only ``rows`` + 1 rows come to the driver.
    """
    sc, group, late = spark.sparkContext, f"adhoc-{uuid.uuid4().hex}", threading.Event()
    before = {k: sc.getLocalProperty(k) for k in GROUP}

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    try:
        frame = checked(spark, sql)
        sc.setJobGroup(group, "ad-hoc statement", interruptOnCancel=True)
        timer.start()
        found = frame.limit(rows + 1).collect()
    except Refused as e:
        return Answer(f"SQL error: {e}", error=True)
    except Exception as e:  # whatever a stranger's statement does is part of the answer
        text = f"query took over {seconds:g} s; narrow it" if late.is_set() else next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)
        return Answer(f"SQL error: {text}", error=True)
    finally:
        timer.cancel()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    values = [list(r) for r in found[:rows]]
    truncated = len(found) > rows
    text = lambda: json.dumps({"columns": frame.columns, "rows": values, "truncated": truncated}, default=str)
    while len(text()) > chars and values:
        values, truncated = values[: len(values) // 2], True
    return Answer(text(), len(values), truncated)
