"""Corpus preparation: messages, conversions to a common row, filters, splits, selection and trajectory queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.selection import seeded


def messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row a conversation with its messages in order."""
    g = df.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(content).alias("content")))).alias("_m"))
    return g.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def last_user_text(msgs: Column) -> Column:
    """Text of the last user message, else of the last message."""
    return F.coalesce(F.try_element_at(F.filter(msgs, lambda m: m["role"] == "user"), F.lit(-1))["content"], F.try_element_at(msgs, F.lit(-1))["content"])


def assistant_spans(df: DataFrame, size: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Start and end of each message in its conversation, and whether its tokens are trained on."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size).over(w)
    return df.select(conv, turn, (end - size).alias("start_at"), end.alias("end_at"), (F.col("role") == "assistant").alias("trained"))


def prompt_row(source: Column, question: Column, answer: Column, index: Column, split: str, ability: str = "math") -> list[Column]:
    """The common prompt row: data_source, prompt, ability, reward_model, extra_info."""
    return [
        source.alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    ]


def coding_row(df: DataFrame, question: str, inputs: str, outputs: str, source: str, min_length: int = 32) -> DataFrame:
    """Rows of the common coding schema; short questions and unequal numbers of inputs and outputs are left out."""
    ok = (F.length(F.trim(question)) >= min_length) & (F.size(inputs) == F.size(outputs)) & (F.size(inputs) > 0)
    return df.filter(ok).select(F.trim(question).alias("question"), F.to_json(F.struct(F.col(inputs).alias("inputs"), F.col(outputs).alias("outputs"))).alias("input_output"), T.question_hash(F.col(question)).alias("qhash"), T.io_fingerprint(F.col(inputs), F.col(outputs)).alias("fingerprint"), F.lit("code").alias("ability"), F.lit(source).alias("_source"))


def sft_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows of each preference."""
    return df.select(prompt, F.explode(F.array(F.struct(F.lit("chosen").alias("kind"), F.col(chosen).alias("response")), F.struct(F.lit("rejected").alias("kind"), F.col(rejected).alias("response")))).alias("_p")).select(prompt, "_p.*")


def preference_layout(chosen: Column, rejected: Column) -> Column:
    """{ids, mask} of a pair of token arrays, stacked and padded with zeros to the longer."""
    n = F.greatest(F.size(chosen), F.size(rejected))
    padded = [F.concat(x, F.array_repeat(F.lit(0), n - F.size(x))) for x in (chosen, rejected)]
    masks = [F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), n - F.size(x))) for x in (chosen, rejected)]
    return F.struct(F.array(*padded).alias("ids"), F.array(*masks).alias("mask"))


def filter_predicates(df: DataFrame, predicates: dict[str, Column], enabled: Sequence[str]) -> DataFrame:
    """The enabled predicates, one after the other."""
    for name in enabled:
        df = df.filter(predicates[name])
    return df


def allow_list(spec: str | None) -> list[str] | None:
    """Names of a comma list; None for all."""
    names = [x.strip().lower() for x in (spec or "").split(",") if x.strip()]
    return None if not names or names in (["all"], ["*"]) else names


def filter_difficulty(df: DataFrame, difficulty: Column, spec: str | None) -> DataFrame:
    names = allow_list(spec)
    return df if names is None else df.filter(F.lower(F.coalesce(difficulty, F.lit(""))).isin(names))


def parse_schedule(spec: str) -> list[tuple[int, str]]:
    """ "until:a+b,until:c" as (bound, comma list) pairs."""
    return [(int(a), b.replace("+", ",")) for a, b in (x.split(":", 1) for x in spec.split(",") if ":" in x)]


def difficulty_rank(difficulty: str, order: Sequence[str]) -> Column:
    """Place of a level in the order; unknown ones last."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.lower(difficulty) == name, i).otherwise(rank)
    return rank


def order_by_difficulty(df: DataFrame, difficulty: str, order: Sequence[str], key: str) -> DataFrame:
    return df.orderBy(difficulty_rank(difficulty, order), key)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement by a hash of seed and key, so the choice doesn't depend on partitions."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def split_by_ratio(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """val or train by rank of a hash: at least one row of validation, never all."""
    n = df.count()
    n_val = min(max(1, int(n * ratio)), max(n - 1, 0))
    chosen = seeded_sample(df.select(key), key, n_val, seed).withColumn("_v", F.lit(True))
    return df.join(chosen, key, "left").withColumn("part", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def head_percent(df: DataFrame, row: str, percent: float, n: int, tail: bool = False) -> DataFrame:
    cut = int(n * percent / 100)
    return df.filter(F.col(row) >= n - cut if tail else F.col(row) < cut)


def episode_filter(df: DataFrame, outcomes: Sequence[str], low: int, high: int) -> DataFrame:
    """Episodes of some outcomes and a number of turns, all of whose actions are valid."""
    return df.filter(F.col("outcome").isin(*outcomes) & F.col("turns").between(low, high) & F.forall("transcript", lambda t: t["valid_action"]))


def episode_messages(df: DataFrame) -> DataFrame:
    """User and assistant messages of each episode; an episode with a blank turn gives none."""
    ok = F.forall("transcript", lambda t: (F.trim(t["user_prompt"]) != "") & (F.trim(t["assistant_response"]) != ""))
    m = F.flatten(F.transform("transcript", lambda t: F.array(F.struct(F.lit("user").alias("role"), t["user_prompt"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["assistant_response"].alias("content")))))
    return df.filter(ok).select("instance_id", m.alias("messages"))


def step_samples(df: DataFrame) -> DataFrame:
    """One row a turn."""
    return df.select("instance_id", F.posexplode("transcript").alias("step", "_t")).select("instance_id", "step", F.col("_t.user_prompt").alias("prompt"), F.col("_t.assistant_response").alias("response"))


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def only_extensions(paths: Column, allowed: Sequence[str], needed: str) -> Column:
    e = F.array_distinct(F.transform(paths, extension_of))
    return (F.size(F.array_except(e, F.array(*map(F.lit, allowed)))) == 0) & F.array_contains(e, needed)


def set_relation(a: Column, b: Column) -> Column:
    """equal, subset, superset, overlap or disjoint."""
    ab, ba = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(ab & ba, "equal").when(ab, "subset").when(ba, "superset").when(F.arrays_overlap(a, b), "overlap").otherwise("disjoint")


def step_totals(df: DataFrame, steps: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Sum and largest of numeric fields over a trajectory's steps, inside the row."""
    out = [F.col(key)]
    for f in fields:
        v = F.transform(F.col(steps)[f], lambda x: x.cast("double"))
        out += [F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias(f"sum_{f}"), F.array_max(v).alias(f"max_{f}")]
    return df.select(*out)


def render_transcript(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("[step "), (i + 1).cast("string"), F.lit("]\n"), s["action"], F.lit("\n"), s["observation"])), "\n")


def patch_text(files: Column, tests: bool | None = None) -> Column:
    """Joined patches of a commit's files, all, or only (non-)test ones; files are structs of path and patch."""
    kept = files if tests is None else F.filter(files, lambda f: T.is_test_path(f["path"]) == F.lit(tests))
    return F.array_join(F.transform(kept, lambda f: f["patch"]), "\n")
