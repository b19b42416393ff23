"""Strata, quotas and deterministic samples of events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ranking import blocked

#: Margins of the sample and their weights.
WEIGHTS = {"size_class": 3.0, "quartile": 2.0, "month": 2.0, "source_class": 2.0, "chain_class": 2.0}


def with_strata(events: DataFrame) -> DataFrame:
    """``events`` plus month, size_class, quartile, source_class and chain_class.

    The quartile of an event with several detections is min(4, ceil(4 rank / n)) by (count, id).
    """
    many = events.where("detection_count > 1").select("event_id", "detection_count")
    n = many.agg(F.count(F.lit(1)).alias("n"))
    ranked = blocked(many, [], F.col("detection_count"), [F.col("event_id")], rank="r").crossJoin(n)  # one row
    quartile = F.least(F.lit(4), F.ceil((F.col("r") + 1) * 4 / F.col("n"))).cast("int")
    placed = ranked.select("event_id", F.concat(F.lit("Q"), quartile.cast("string")).alias("quartile"))
    return events.join(placed, "event_id", "left").withColumns({
        "quartile": F.coalesce("quartile", F.lit("not_applicable")), "month": F.date_format("start_ts", "yyyy-MM"), "size_class": F.when(F.col("detection_count") == 1, "singleton").otherwise("multi_detection"),
        "source_class": F.when(F.col("source_count") > 1, "multiple_sources").otherwise("single_source"), "chain_class": F.when(F.col("possible_chain_merge"), "possible_chain_merge").otherwise("no_possible_chain_merge"),
    })


def largest_remainder(counts: dict[str, int], target: int) -> dict[str, int]:
    """Shares of ``target`` in proportion to counts: none above its count, none empty if there is room, ties by key."""
    have = {k: n for k, n in counts.items() if n > 0}
    total = sum(have.values())
    if not 0 < target <= total:
        raise ValueError(f"{target} of {total} cannot be shared out")
    exact = {k: target * n / total for k, n in have.items()}
    quota = {k: min(have[k], math.floor(x)) for k, x in exact.items()}
    if target >= len(quota):
        quota = {k: max(1, q) for k, q in quota.items()}
    rest = lambda k: (exact[k] - quota[k], k)
    while (over := sum(quota.values()) - target) != 0:
        open_ = [k for k in quota if (quota[k] > 1 if over > 0 else quota[k] < have[k])]
        if not open_:
            break
        quota[(min if over > 0 else max)(open_, key=rest)] += -1 if over > 0 else 1
    return quota


def quotas(rows: DataFrame, field: str, target: int) -> dict[str, int]:
    """Quotas of a field's classes; only the class counts reach the driver."""
    return largest_remainder({r[0]: r[1] for r in rows.groupBy(field).count().collect()}, target)


def seeded_order(seed: int, *parts: Column | str) -> Column:
    """A hash by which rows are shuffled the same way every time."""
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def plan_sample(cells: dict[tuple, int], size: int) -> dict[tuple, int]:
    """How many to take of each cell (size_class, quartile, month, source_class, chain_class).

    Greedy by deficit: the next one comes from the cell whose classes are most behind their quotas,
    size and quartile quotas being hard; then single swaps repair margins while they help. The
    work is over cells, whose number the strata bound, never over rows.
    """
    fields = list(WEIGHTS)
    count = lambda i, only=None: {v: sum(n for c, n in cells.items() if c[i] == v and (only is None or c[0] == only)) for v in {c[i] for c in cells}}
    goal = {f: largest_remainder(count(i), size) for i, f in enumerate(fields) if f != "quartile"}
    many = goal["size_class"].get("multi_detection", 0)
    goal["quartile"] = largest_remainder({k: n for k, n in count(1, "multi_detection").items() if n}, many) if many else {}
    have = {f: dict.fromkeys({c[i] for c in cells}, 0) for i, f in enumerate(fields)}
    take = dict.fromkeys(sorted(cells), 0)

    def add(cell: tuple, n: int) -> None:
        take[cell] += n
        for f, v in zip(fields, cell):
            have[f][v] += n

    def gain(cell: tuple) -> float:
        total = 0.0
        for f, v in zip(fields, cell):
            want = goal[f].get(v, 0)
            total += WEIGHTS[f] * max(0, want - have[f][v]) / want if want else 0.0
        return total

    def allowed(cell: tuple) -> bool:
        hard = have["size_class"][cell[0]] < goal["size_class"].get(cell[0], 0)
        return hard and (cell[0] != "multi_detection" or have["quartile"][cell[1]] < goal["quartile"].get(cell[1], 0)) and take[cell] < cells[cell]

    for _ in range(size):
        open_ = [c for c in take if allowed(c)]
        if not open_:
            break
        add(max(open_, key=lambda c: (gain(c), [-ord(x) for x in "".join(c)])), 1)

    def error() -> int:
        return sum(abs(goal[f].get(v, 0) - n) for f in fields[2:] for v, n in have[f].items())

    best = error()
    while best:
        swap = None
        for out in [c for c, n in take.items() if n]:
            for into in [c for c in take if take[c] < cells[c] and c[:2] == out[:2] and c != out]:
                add(out, -1), add(into, 1)
                if error() < best:
                    best, swap = error(), (out, into)
                add(into, -1), add(out, 1)
        if swap is None:
            break
        add(swap[0], -1), add(swap[1], 1)
    return {c: n for c, n in take.items() if n}


def stratified_sample(strata: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` events that follow the quotas of every margin as nearly as single swaps allow."""
    fields = list(WEIGHTS)
    cells = {tuple(r[f] for f in fields): r["count"] for r in strata.groupBy(*fields).count().collect()}
    plan = strata.sparkSession.createDataFrame([(*c, n) for c, n in plan_sample(cells, size).items()], ", ".join(f"{f} string" for f in fields) + ", __take long")
    ordered = blocked(strata.withColumn("__h", seeded_order(seed, "event_id")), fields, F.substring("__h", 1, 2), [F.col("__h"), F.col("event_id")], rank="__r")
    return ordered.join(F.broadcast(plan), fields).where("__r < __take").drop("__h", "__r", "__take")


def blind_order(items: DataFrame, slots: list[str], seed: int, round_id: str, protocol: str) -> DataFrame:
    """(slot, order, alias, event_id): every slot sees the items in its own hidden order under its own aliases."""
    rows = items.select("event_id").withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    digest = F.sha2(F.concat_ws("\x00", F.lit(round_id), F.lit(protocol), F.col("slot"), F.lit(str(seed)), F.col("event_id")), 256)
    ranked = blocked(rows.withColumn("digest", digest), ["slot"], F.substring("digest", 1, 2), [F.col("digest"), F.col("event_id")], rank="r")
    return ranked.select("slot", (F.col("r") + 1).alias("order"), F.format_string("%s-%04d", F.col("slot"), F.col("r") + 1).alias("alias"), "event_id", "digest")


def blinded(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The public rows (slot, order, alias, digest; no id) and the private map (slot, alias, event_id)."""
    return orders.select("slot", "order", "alias", "digest"), orders.select("slot", "alias", "event_id")
