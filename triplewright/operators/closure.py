"""Transitive closure by path doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.workspace import Workspace
from ..settings import Settings
from .joins import hot_values, measured_small, skew_join
from .sets import unseen


def compose(left: DataFrame, right: DataFrame, by: list[str], hot_mid_left=(), hot_mid_right=(),
            salts: int = 32, small: str | None = None) -> DataFrame:
    """(by, src, mid) x (by, mid, dst) -> (by, src, dst) with src != dst. Both inputs have src, dst."""
    first = left.selectExpr(*by, "src", "dst as mid")
    second = right.selectExpr(*by, "src as mid", "dst")
    joined = skew_join(first, second, [*by, "mid"], "mid", hot_mid_left, hot_mid_right, salts, small)
    return joined.where("src <> dst").select(*by, "src", "dst")


def transitive_closure(ws: Workspace, edges: DataFrame, by: list[str] | None = None,
                       settings: Settings = Settings()) -> DataFrame:
    """All pairs (src, dst), src != dst, joined by a path of edges that agree on the ``by`` columns.

    After k rounds ``pairs`` has those at a distance below 2^k and ``far`` those at exactly 2^k. Pairs composed
    with far ones reach all distances in between, and far ones composed with far ones the next power. Parts of
    a shortest path are shortest, so nothing is missed, and on a chain every pair is found once. The loop
    ends when no pair is that far.
    """
    by = list(by or [])
    edges = edges.select(*by, "src", "dst")
    pairs = ws.rounds("closure", edges.schema, settings.rows_per_file)
    far, rows = edges.where("src <> dst").distinct(), None
    while rows != 0:
        older, known = pairs.last, sum(pairs.counts)
        rows = pairs.append(far)
        if not rows:
            break
        far = pairs.read(pairs.last)
        small = measured_small(far, rows, settings)
        src, dst = (hot_values(far, c, settings, rows) for c in ("src", "dst"))
        if known:
            near = pairs.read(0, older)
            hot = hot_values(near, "dst", settings, known)
            between = compose(near, far, by, hot, src, settings.salts, "right" if small else None)
            pairs.append(unseen(between, pairs.read()))
        far = unseen(compose(far, far, by, dst, src, settings.salts, "right" if small else None), pairs.read())
    return pairs.read()
