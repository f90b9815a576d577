"""Windows of random conversations: the budget, what is repeated, and the turns and targets read back."""

import random

import pytest

from lodestar.llm import chat
from pyspark.sql import functions as F


def tokens(text: str) -> int:
    return -(-len(text) // chat.CHARS_PER_TOKEN) + chat.TURN_TOKENS


def conversation(rng, n):
    """(role, text) of n turns: of all sizes around the budget, with a system turn anywhere or none."""
    sizes = [rng.choice([0, 1, 3, 50, 128, 255, 256, 257, 400, 508, 509, 700, rng.randint(0, 600)]) for _ in range(n)]
    roles = [rng.choice(["user", "assistant"]) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 1, 2])):
        roles[rng.choice([0, 0, rng.randrange(n)])] = "system"
    return [(role, f"{i}:".ljust(4 * size, "x")) for i, (role, size) in enumerate(zip(roles, sizes))]


@pytest.mark.parametrize("budget", [64, 512])
def test_windows_keep_to_the_budget(spark, budget):
    rng = random.Random(budget)
    said = {c: conversation(rng, rng.randint(1, 40)) for c in range(60)}
    said[100] = [("system", "s" * 984), ("user", "u" * 12), *[("assistant" if i % 2 else "user", "x" * (4 * n)) for i, n in enumerate((124, 124, 252, 251, 124, 124))]]
    rows = [(c, i, *turn) for c, turns in said.items() for i, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    back: dict = {c: [] for c in said}
    for r in chat.windows(df, budget).withColumn("turns", chat.read_back(F.col("formatted"))).orderBy("conv_id", "window").collect():
        turns, all_ = [(t["role"], t["text"]) for t in r["turns"]], said[r["conv_id"]]
        context, own = turns[: r["n_context"]], turns[r["n_context"] :]
        size = [tokens(t) for _, t in own]
        assert r["tokens"] == sum(tokens(t) for _, t in turns)
        assert r["tokens"] <= budget or len(own) == 1 and size[0] > budget
        first = len(back[r["conv_id"]])
        assert r["window"] == first + 1
        before = all_[:first]
        system = next((t for t in before if t[0] == "system"), None)
        if system and (tokens(system[1]) + sum(size) <= budget or sum(size) > budget):
            assert context.count(system) == 1  # turns go in their order, so short history may stand before it
            context, before = ([t for t in turns_ if t != system] for turns_ in (context, before))
        assert len(context) <= chat.HISTORY and sum(tokens(t) for _, t in context) <= chat.HISTORY_TOKENS
        assert context == (before[-len(context) :] if context else [])
        back[r["conv_id"]] += own
        targets = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss"]]
        assert targets == [t for role, t in own if role == "assistant"]
    assert back == said
