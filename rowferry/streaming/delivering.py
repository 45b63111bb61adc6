"""The delivery loop: events arrive in a feed and are delivered in passes of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TargetContract, TargetProfile
from ..operators import events as outbox_ops
from ..operators.lookups import CROSSWALK_KEY
from ..operators.union import union_all
from ..plans import delivery
from ..sources.workspace import materialise
from .commits import Commits

# Fixed value: events that one pass claims.
LIMIT = 100

_OWN = {"outbox": ("event_id",), "quarantine": ("event_id",), "envelope": ("event_id",), "audit": ("event_id", "attempt")}
_CROSSWALK = "_crosswalk"


def store(spark: SparkSession, root: str, contract: TargetContract, tables: Sequence[str]) -> Commits:
    """Where a loop keeps the target tables and its own: outbox, crosswalk, quarantine, envelope and audit."""
    return Commits(spark, root, {**{n: (contract.table(n).primary_key,) for n in tables}, **_OWN, _CROSSWALK: CROSSWALK_KEY})


def begin(commits: Commits, state: delivery.TargetState, own: dict[str, DataFrame]) -> None:
    """Stores what is there before the loop starts for the first time."""
    commits.start({**state.tables, _CROSSWALK: state.crosswalk, **own})


def target_of(frames: dict[str, DataFrame]) -> delivery.TargetState:
    return delivery.TargetState({n: df for n, df in frames.items() if n not in _OWN and n != _CROSSWALK}, frames[_CROSSWALK])


def arrived(rows: DataFrame, box: DataFrame) -> DataFrame:
    """Each event once that the outbox does not have.

    Ids are looked at alone, so that only rows whose id comes again, or is in the outbox, are brought together.
    """
    ids = union_all(rows.select("event_id", F.lit(1).alias("_came"), F.lit(0).alias("_had")),
                    box.select("event_id", F.lit(0).alias("_came"), F.lit(1).alias("_had")))
    counted = ids.groupBy(F.col("event_id").alias("_again")).agg(F.sum("_came").alias("_came"), F.sum("_had").alias("_had"))
    again = materialise(counted.filter("_came > 0 AND _came + _had > 1").select("_again"))
    same = F.col("event_id").eqNullSafe(F.col("_again"))
    others = rows.join(again, same, "left_semi").dropDuplicates(["event_id"]).join(box.select("event_id"), "event_id", "left_anti")
    return materialise(union_all(rows.join(again, same, "left_anti").select(*box.columns), others.select(*box.columns)))


def pass_over(
    commits: Commits, control: DataFrame, entities: Sequence[delivery.Entity], contract: TargetContract, profile: TargetProfile,
    system: str, clock: Callable[[], Column], limit: int = LIMIT, share: float = 0.0,
) -> Callable[[DataFrame, int], None]:
    """Batch handler: new events join the outbox, the oldest due ones are delivered, and all tables change together.

    The changes of target tables, crosswalk, outbox, quarantine, envelope and audit are committed under the number of the batch.
    A batch that is repeated, after its commit or before it, leaves the same state. An event that the outbox has already is not taken
    in again.

    `limit` is what one worker claims. Workers may be at work side by side, each skipping what others have claimed; a pass is one
    worker or, with `share`, as many as claim that share of what is due. A backlog then takes a number of passes that grows with
    its logarithm, and no event is claimed before an older one. An event is claimed by one pass, whatever the number of workers.
    """
    def handle(rows: DataFrame, batch: int) -> None:
        if commits.done(batch):
            return
        now = commits.read(batch)
        box = now["outbox"]
        fresh = None if rows.isEmpty() else arrived(rows, box)
        box, moment = box if fresh is None else union_all(box, fresh), clock()
        due = outbox_ops.claimable(box, control, moment).count() if share else 0
        most = limit * max(1, math.ceil(share * due / limit))
        done = delivery.deliver_all(box, control, target_of(now), now["quarantine"], now["envelope"], entities,
                                    contract, profile, system, moment, None if share and due <= most else most)
        changed = dict(done.target.changed)
        links = changed.pop(delivery.CROSSWALK, None)
        touched = done.changed.get("outbox")
        if fresh is not None and touched is not None:  # written, as the commit counts its rows and looks at their keys
            waiting = materialise(fresh.join(touched.select("event_id"), "event_id", "left_anti").select(*touched.columns))
            changed["outbox"] = union_all(waiting, touched)
        elif fresh is not None or touched is not None:
            changed["outbox"] = touched if fresh is None else fresh
        changed |= {n: df for n, df in done.changed.items() if n != "outbox"}
        if links is not None:
            changed[_CROSSWALK] = links
        if touched is not None:
            changed["audit"] = done.audit.select(*now["audit"].columns)
        commits.commit(batch, changed)

    return handle


def work_off(commits: Commits, control: DataFrame, clock: Column) -> bool:
    """Whether events are due that no pass has claimed yet."""
    return not outbox_ops.claimable(commits.read()["outbox"], control, clock).isEmpty()
