"""State graphs of trajectories: edges, distances by relaxation, paths, returns by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.state import cut

SUCCESS = "success"


def edges(steps: DataFrame, reward: str = "reward") -> DataFrame:
    """(uid, u, v, traj_uid, step): each step's state to the next; a rewarded trajectory ends in success."""
    w = Window.partitionBy("uid", "traj_uid")
    last = F.max("step").over(w) == F.col("step")
    total = F.sum(reward).over(w)
    v = F.when(last & (total > 0), F.lit(SUCCESS)).otherwise(F.col("next_obs"))
    return steps.withColumn("_v", v).filter("_v IS NOT NULL").select("uid", F.col("anchor_obs").alias("u"), F.col("_v").alias("v"), "traj_uid", "step")


def neighbours(e: DataFrame) -> DataFrame:
    return e.select("uid", "u", "v").distinct()


def parallel_edges(e: DataFrame) -> DataFrame:
    """Slot of each edge among the parallel ones, and whether the reverse edge exists."""
    slot = F.row_number().over(Window.partitionBy("uid", "u", "v").orderBy("traj_uid", "step")) - 1
    back = neighbours(e).select("uid", F.col("u").alias("v"), F.col("v").alias("u"), F.lit(True).alias("_b"))
    return e.withColumn("slot", slot).join(back, ["uid", "u", "v"], "left").withColumn("has_reverse", F.coalesce("_b", F.lit(False))).drop("_b")


def distances_to(e: DataFrame, target: str = SUCCESS, weight: str | None = None) -> DataFrame:
    """(uid, state, d): least distance to the target per group; unreachable states get the largest finite one plus 1.

    Relaxation over distinct edges (the lightest of parallel ones); a frontier of improved states is joined each round,
    until no state improves. Weights that go round in a negative cycle raise an error."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    best = cut(e.groupBy("uid", "u", "v").agg(F.min(w).alias("w")))
    states = best.select("uid", F.col("u").alias("state")).union(best.select("uid", F.col("v").alias("state"))).distinct()
    d = cut(best.select("uid").distinct().select("uid", F.lit(target).alias("state"), F.lit(0.0).alias("d")))
    frontier = d
    rounds, bound = 0, None if weight is None else states.count()
    while True:
        step = best.join(frontier.select("uid", F.col("state").alias("v"), "d"), ["uid", "v"]).groupBy("uid", F.col("u").alias("state")).agg(F.min(F.col("w") + F.col("d")).alias("d"))
        better = cut(step.join(d.withColumnRenamed("d", "_d"), ["uid", "state"], "left").filter("_d IS NULL OR d < _d").select("uid", "state", "d"))
        if better.isEmpty():
            break
        d = cut(d.join(better, ["uid", "state"], "left_anti").unionByName(better))
        frontier = better
        rounds += 1
        if bound is not None and rounds > bound:
            raise ValueError("a negative cycle: distances have no least value")
    far = F.max("d").over(Window.partitionBy("uid")) + 1
    return states.join(d, ["uid", "state"], "left").select("uid", "state", F.coalesce("d", far).alias("d"))


#: Distance of a target that can't be reached; a fixed value.
NO_PATH = 51.0


def shortest_paths(e: DataFrame, ends: DataFrame, weight: str | None = None, missing: float | None = NO_PATH) -> DataFrame:
    """(uid, source, target, path, d) for each row of ``ends``: the lightest path of a group's graph, and its weight.

    Of parallel edges the lightest counts; without ``weight`` every edge weighs one. Of paths of equal weight the one of
    fewest edges wins, then, from the target back, the one through the smallest state. A target that can't be reached,
    and states that the graph doesn't have, give a null path and ``missing``; a source is at distance 0 of itself.

    States are relaxed from all sources at once, those that improved in a round are joined to the edges in the next, and a
    predecessor is kept with each. Paths are then read off by ancestors 1, 2, 4, ... steps back, in as many rounds as
    the longest path's length has binary digits; no path is carried through the relaxation."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    best = cut(e.groupBy("uid", "u", "v").agg(F.min(w).alias("w")))
    ends = cut(ends.select("uid", "source", "target").distinct())
    label = F.struct("d", "hops", "pred", "fresh").alias("b")
    first = F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("hops"), F.lit(None).cast(dict(e.dtypes)["u"]).alias("pred"), F.lit(1).alias("fresh")).alias("b")
    reached = cut(ends.select("uid", "source").distinct().select("uid", "source", F.col("source").alias("state"), first))
    bound, rounds = None, 0
    while True:
        front = reached.filter("b.fresh = 1").select("uid", "source", F.col("state").alias("u"), "b.d", "b.hops")
        if front.isEmpty():
            break
        step = front.join(best, ["uid", "u"]).select("uid", "source", F.col("v").alias("state"), (F.col("d") + F.col("w")).alias("d"), (F.col("hops") + 1).alias("hops"), F.col("u").alias("pred"), F.lit(1).alias("fresh")).select("uid", "source", "state", label)
        old = reached.withColumn("b", F.col("b").withField("fresh", F.lit(0)))
        reached = cut(old.unionByName(step).groupBy("uid", "source", "state").agg(F.min("b").alias("b")))
        rounds += 1
        if weight is not None and rounds % 50 == 0:
            bound = bound or best.select("uid", F.explode(F.array("u", "v"))).distinct().count()
            if rounds > bound:
                raise ValueError("a negative cycle: paths have no least weight")
    tree = reached.select("uid", "source", "state", "b.d", "b.hops", "b.pred")
    hit = cut(ends.join(tree.withColumnRenamed("state", "target"), ["uid", "source", "target"]).select("uid", "source", "target", "d", "hops"))
    longest = hit.agg(F.max("hops").alias("h")).first().h or 0
    back = [tree.filter("pred IS NOT NULL").select("uid", "source", "state", F.col("pred").alias("up"))]
    for _ in range(1, longest.bit_length()):
        far = back[-1].select("uid", "source", F.col("state").alias("up"), F.col("up").alias("further"))
        back.append(cut(back[-1].join(far, ["uid", "source", "up"]).select("uid", "source", "state", F.col("further").alias("up"))))
    places = hit.select("uid", "source", "target", F.col("target").alias("state"), F.col("hops").alias("at"))
    for k in reversed(range(longest.bit_length())):
        more = places.join(back[k], ["uid", "source", "state"]).select("uid", "source", "target", F.col("up").alias("state"), (F.col("at") - (1 << k)).alias("at"))
        places = places.unionByName(more)
    paths = places.groupBy("uid", "source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "state"))), lambda x: x["state"]).alias("path"))
    found = ends.join(hit, ["uid", "source", "target"], "left").join(paths, ["uid", "source", "target"], "left")
    return found.select("uid", "source", "target", "path", F.coalesce("d", F.lit(missing)).alias("d"))


def path_returns(steps: DataFrame, e: DataFrame, gamma: float = 0.95, scale: float = 10.0) -> DataFrame:
    """scale * gamma ** (d(next) - d(state) + 1): progress towards success along each step."""
    d = distances_to(e)
    x = e.join(d.select("uid", F.col("state").alias("u"), F.col("d").alias("du")), ["uid", "u"]).join(d.select("uid", F.col("state").alias("v"), F.col("d").alias("dv")), ["uid", "v"])
    return x.select("uid", "traj_uid", "step", (scale * F.pow(F.lit(gamma), F.col("dv") - F.col("du") + 1)).alias("ret"))


def trajectory_paths(e: DataFrame) -> DataFrame:
    g = e.groupBy("uid", "traj_uid").agg(F.sort_array(F.collect_list(F.struct("step", "u", "v"))).alias("s"))
    return g.select("uid", "traj_uid", F.concat(F.transform("s", lambda x: x["u"]), F.array(F.element_at("s", -1)["v"])).alias("path"))


def success_states(steps: DataFrame, reward: str = "reward", threshold: float = 0.0) -> DataFrame:
    """All states of trajectories whose total exceeds the threshold, and the last next state."""
    g = steps.groupBy("uid", "traj_uid").agg(F.sum(reward).alias("r"), F.sort_array(F.collect_list(F.struct("step", "anchor_obs"))).alias("s"), F.max_by("next_obs", "step").alias("last"))
    return g.filter(F.col("r") > threshold).select("uid", "traj_uid", F.transform("s", lambda x: x["anchor_obs"]).alias("states"), "last")


def simple_paths(e: DataFrame, source: str, target: str, depth: int | None = None) -> DataFrame:
    """All paths without a repeated state; their number grows exponentially with the states, so a caller may name a depth."""
    n = neighbours(e)
    n = n if depth else cut(n)
    walk = n.filter((F.col("u") == source) & (F.col("v") != source)).select("uid", F.array("u", "v").alias("path"), F.col("v").alias("at"))
    found = walk.filter(F.col("at") == target)
    length = 1
    while length != depth:
        walk = walk.filter(F.col("at") != target).join(n.select("uid", F.col("u").alias("at"), "v"), ["uid", "at"]).filter(~F.array_contains("path", F.col("v"))).select("uid", F.concat("path", F.array("v")).alias("path"), F.col("v").alias("at"))
        if depth is None:
            walk = cut(walk)
            if walk.isEmpty():
                break
        length += 1
        found = found.unionByName(walk.filter(F.col("at") == target))
    return found.select("uid", "path")


def mandatory_between(e: DataFrame, ends: DataFrame) -> DataFrame:
    """(uid, mid): states without which a group's ``target`` can't be reached from its ``source``; ``ends`` has a row of both a group."""
    n = cut(neighbours(e))
    ends = cut(ends.select("uid", "source", "target"))
    both = n.select("uid", F.explode(F.array("u", "v")).alias("mid")).join(ends, "uid")
    mids = both.filter("mid <> source AND mid <> target").select("uid", "mid", "source").distinct()
    reach = cut(mids.select("uid", "mid", F.col("source").alias("at")))
    front = reach
    while True:
        nxt = front.join(n.select("uid", F.col("u").alias("at"), "v"), ["uid", "at"]).filter(F.col("v") != F.col("mid")).select("uid", "mid", F.col("v").alias("at")).distinct()
        front = cut(nxt.join(reach, ["uid", "mid", "at"], "left_anti"))
        if front.isEmpty():
            break
        reach = cut(reach.unionByName(front))
    around = reach.join(ends, "uid").filter("at = target").select("uid", "mid")
    return mids.select("uid", "mid").join(around, ["uid", "mid"], "left_anti")


def mandatory_states(e: DataFrame, source: str, target: str) -> DataFrame:
    """States without which the target can't be reached from the source, per group."""
    return mandatory_between(e, e.select("uid").distinct().select("uid", F.lit(source).alias("source"), F.lit(target).alias("target")))


def golden_states(candidates: DataFrame, e: DataFrame, state: str = "state", order: str = "pos") -> DataFrame:
    """Candidates of a group in order, without inner ones that some path from the first to the last avoids; where no path exists, all inner ones stay."""
    w = Window.partitionBy("uid")
    c = candidates.withColumn("_a", F.min_by(state, order).over(w)).withColumn("_b", F.max_by(state, order).over(w)).withColumn("_end", (F.col(order) == F.min(order).over(w)) | (F.col(order) == F.max(order).over(w)))
    needed = mandatory_between(e, c.groupBy("uid").agg(F.first("_a").alias("source"), F.first("_b").alias("target"))).select("uid", F.col("mid").alias(state), F.lit(True).alias("_m"))
    return c.join(needed, ["uid", state], "left").filter(F.col("_end") | F.col("_m")).select(*candidates.columns)


def segment_returns(steps: DataFrame, golden: str, gamma: float = 0.95, hit_reward: float = 10.0) -> DataFrame:
    """A hit of a golden state (boolean column) closes a segment and is worth ``hit_reward``, discounted back inside it; steps after the last hit get 0."""
    w = Window.partitionBy("uid", "traj_uid").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    seg = F.sum(F.col(golden).cast("int")).over(w)
    d = steps.withColumn("_s", seg)
    end = F.max("step").over(Window.partitionBy("uid", "traj_uid", "_s"))
    return d.withColumn("ret", F.when(F.col("_s") == 0, 0.0).otherwise(hit_reward * F.pow(F.lit(gamma), end - F.col("step")))).drop("_s")
