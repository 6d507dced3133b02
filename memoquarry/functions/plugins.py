"""Plug-in points: embeddings, segment compression and slot merging by user functions, run as Pandas UDFs (EM1, EM3, EM4, EM6, EM7, L1i, ST16).

A plug-in is a plain function from a list of inputs to a list of outputs, so that a provider may batch its calls.  None
is built in that needs a network; without a plug-in, or where it fails for a row (it returns None), the rules of
``functions.text`` stand in.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoquarry.functions import text as T
from memoquarry.shipping import ship

Embedder = Callable[[list[str]], list[list[float] | None]]
Writer = Callable[[list[str]], list[str | None]]

#: Providers by name; ``register`` adds one.  The order in which "auto" looks for one, ending with the hash embedding.
PROVIDERS: dict[str, Embedder] = {}
AUTO = ("google", "openai", "local")


def register(name: str, provider: Embedder) -> None:
    PROVIDERS[name] = provider


def embedded(df: DataFrame, text: str, provider: str = "auto", dim: int = 64, name: str = "embedding") -> DataFrame:
    """``df`` with an embedding of ``text``: by the named provider, "auto" by the first that is registered, else by hash; null where it fails."""
    chosen = next((p for p in AUTO if p in PROVIDERS), "hash") if provider == "auto" else provider
    if chosen == "hash":
        return T.with_hash_embedding(df, text, dim, name)
    return df.withColumn(name, _batched(df, PROVIDERS[chosen], "array<double>")(F.col(text)))


def _batched(df: DataFrame, function: Callable, kind: str):
    ship(df.sparkSession)

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        given = [(i, v) for i, v in enumerate(values) if v is not None]
        out: list = [None] * len(values)
        try:
            for (i, _), result in zip(given, function([v for _, v in given])):
                out[i] = result
        except Exception:  # noqa: BLE001  a failed provider yields nulls, and recall goes on by words
            pass
        return pd.Series(out, index=values.index)

    return run


def compressed(df: DataFrame, whole: str, lines: str, writer: Writer | None = None, most: int = 600) -> Column:
    """A summary of the text ``whole``, whose turns are ``lines``: the writer's, or the rules' where there is none."""
    rules = T.compress(F.col(lines), T.key_facts(F.col(whole)), most)
    return rules if writer is None else F.coalesce(_batched(df, writer, "string")(F.col(whole)), rules)


def heads(lines: Column, most: int = 500) -> Column:
    """What stands in for a writer that fails as a whole: the first 100 characters of each turn, 500 in all."""
    return F.substring(F.array_join(F.transform(lines, lambda x: F.substring(x, 1, 100)), "\n"), 1, most)


def merged(df: DataFrame, old: str, new: str, writer: Writer | None = None, most: int = 1200) -> Column:
    """Slot text after a merge: the writer's of both, or both joined, the last ``most`` characters kept."""
    joined = F.right(F.concat(F.col(old), F.lit("\n"), F.col(new)), F.lit(most))
    return joined if writer is None else F.coalesce(_batched(df, writer, "string")(F.concat(F.col(old), F.lit("\n"), F.col(new))), joined)
