"""Slot allocation: the one operator that needs its rows in order, a namespace at a time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.functions import text as T
from memoquarry.shipping import ship

SLOTS, RATE, BOOST, EVICT, SATURATED, KEEP_CHARS = 4, 0.95, 1.5, 0.05, 0.6, 1200
OUT = "conv_id long, turn long, decision string, slot int, evicted int, active int"


def empty_slots(n: int = SLOTS) -> list[dict]:
    return [{"text": "", "a": 1.0, "words": []} for _ in range(n)]


def step(slots: list[dict], text: str, importance: float, explicit: bool, words: list[str]) -> tuple[str, int, int]:
    """Decide, decay every held slot, write, evict; returns (decision, slot or -1, evicted)."""
    held = [i for i, s in enumerate(slots) if s["text"]]
    mine = set(words)
    near = max(((len(mine & set(slots[i]["words"])) / max(len(mine | set(slots[i]["words"])), 1), -i) for i in held), default=(0.0, 0))
    sim, best = near[0], -near[1]
    novel, decision, slot, strength = not held or sim < 0.7, "reject", -1, 0.0
    if explicit or (novel and importance >= 0.20):
        free = next((i for i, s in enumerate(slots) if not s["text"]), None)
        if not novel:
            decision, slot = "update", best
        elif free is not None:
            decision, slot = "new", free
        else:
            weakest = min(held, key=lambda i: (slots[i]["a"], i))
            if slots[weakest]["a"] <= SATURATED:
                decision, slot = "overwrite", weakest
        strength = max(importance, 0.4)
    elif sim >= 0.7 and importance >= 0.2:
        decision, slot, strength = ("merge" if sim > 0.9 else "update"), best, max(importance, 0.3)
    for i in held:
        slots[i]["a"] *= RATE
    if slot >= 0:
        s = slots[slot]
        old = "" if decision in ("new", "overwrite") else s["text"]
        s["text"] = (old + "\n" + text if old else text)[-KEEP_CHARS:]
        s["words"] = sorted(mine if not old else mine | set(s["words"]))
        s["a"] = min(1.0, s["a"] + strength * BOOST)
    gone = [s for s in slots if s["text"] and s["a"] < EVICT]
    for s in gone:
        s["text"], s["words"] = "", []
    return decision, slot, len(gone)


def features(turns: DataFrame) -> DataFrame:
    """What a step needs of each turn, as Column expressions."""
    rows = T.with_importance(turns.select("conv_id", "turn", "role", "text"))
    return rows.select("conv_id", "turn", "text", "importance", (F.col("role") == "system").alias("explicit"), F.array_distinct(T.tokenize(F.lower("text"))).alias("words"))


def run(pdf: pd.DataFrame, slots: list[dict]) -> pd.DataFrame:
    out = []
    for r in pdf.sort_values("turn").itertuples():
        decision, slot, gone = step(slots, r.text, r.importance, bool(r.explicit), list(r.words))
        out.append((r.conv_id, r.turn, decision, slot, gone, sum(bool(s["text"]) for s in slots)))
    return pd.DataFrame(out, columns=["conv_id", "turn", "decision", "slot", "evicted", "active"])


def replay(turns: DataFrame) -> DataFrame:
    """One row per turn with what the gate decided.  A namespace is sequential; namespaces run in parallel."""
    ship(turns.sparkSession)
    return features(turns).groupBy("conv_id").applyInPandas(lambda pdf: run(pdf, empty_slots()), OUT)


def dump(slots: list[dict]) -> str:
    return json.dumps(slots)


def load(state: str) -> list[dict]:
    return json.loads(state)
