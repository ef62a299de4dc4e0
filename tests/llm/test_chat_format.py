from __future__ import annotations

import itertools
import random

import pytest

from tallybook.llm import chat_format as chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, block string"


def cheapest(roles):
    """Least price of a conversation, by the rules as the docstring has them, not by the module's tables."""
    follows = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    relabel, merge, insert = 3, 1, 2
    reached = {"": 0}
    for role in [*roles, "end"]:
        # Empty turns may be put in before the turn, or at the end; a system turn is never put in.
        for _ in range(2 if role == "end" else 1):
            inserted = dict(reached)
            for state, cost in reached.items():
                for to in follows[state]:
                    if to != "system":
                        inserted[to] = min(inserted.get(to, 10**9), cost + insert)
            if role == "end":
                reached = inserted
        if role == "end":
            return min(reached.get("assistant", 10**9), reached.get("", 10**9))
        after: dict = {}
        for state, cost in inserted.items():
            for to in follows[state]:
                after[to] = min(after.get(to, 10**9), cost + (0 if role == to else relabel))
        for state, cost in reached.items():
            if state:
                price = cost + merge + (0 if role == state else relabel)
                after[state] = min(after.get(state, 10**9), price)
        reached = after


def legal(text):
    roles = [part.split("\n")[0].removesuffix("|>") for part in text.split("<|")[1:] if not part.startswith("end")]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2)


@pytest.mark.parametrize("block", [512, 3, 1])
def test_cheapest_legal_order(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "BATCH", 5 * block)
    draw = random.Random(block)
    names = ["system", "user", "assistant", "tool", None]
    talks = {n: [draw.choice(names) for _ in range(draw.randint(1, 12))] for n in range(40)}
    talks |= {100 + n: list(roles) for n, roles in enumerate(itertools.product(names, repeat=2))}
    rows = [(c, n, role, f"t{c}.{n}", "k", "b") for c, roles in talks.items() for n, role in enumerate(roles)]
    rows.append((7000, None, "user", None, "k", "b"))
    rows += [(None, 1, "user", "same", "k", "b")] * 2
    talks |= {7000: ["user"], None: ["user", "user"]}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found: dict = {}
    for r in chat.formatted(frame).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert found.keys() == talks.keys()
    for conv_id, roles in talks.items():
        own = sorted(found[conv_id], key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(roles)))
        assert sum(r.cost for r in own) == cheapest(roles)
        text = "".join(r.rendered for r in own)
        assert legal(text), (roles, text)
        assert text.count("<|end|>") == text.count("|>\n") - text.count("<|end|>\n")
        for r in own:
            assert (r.action == "keep") == (r.role == r.new_role and r.action != "merge")
    assert "".join(r.rendered for r in found[None]).count("same") == 2


def test_a_legal_conversation_stays(spark):
    rows = [(1, n, role, f"{n}", "", "") for n, role in enumerate(["system", "user", "assistant"])]
    text = "".join(r.rendered for r in sorted(chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.place))
    assert text == "<|system|>\n0<|end|>\n<|user|>\n1<|end|>\n<|assistant|>\n2<|end|>\n"


def test_one_long_conversation_beside_short_ones(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    monkeypatch.setattr(chat, "BATCH", 50)
    draw = random.Random(2)
    talks = {n: [draw.choice(["user", "assistant", "x"]) for _ in range(700 if n == 3 else 2)] for n in range(60)}
    rows = [(c, n, role, "", "", "") for c, roles in talks.items() for n, role in enumerate(roles)]
    found: dict = {}
    for r in chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        found[r.conv_id] = found.get(r.conv_id, 0) + r.cost
    assert found == {c: cheapest(roles) for c, roles in talks.items()}


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
