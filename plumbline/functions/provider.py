"""

A provider turns rows into feature rows, batch by batch in Arrow. A registry names providers; a chain asks the next one
for the rows that the one before could not do, and says in a reason why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Measure = Callable[[pd.DataFrame], pd.DataFrame]


class Provider:
    """name, the input columns it needs, the columns it gives as a DDL string, and measure: frame -> frame of equal rows."""

    def __init__(self, name: str, inputs: Sequence[str], outputs: str, measure: Measure):
        self.name, self.inputs, self.outputs, self.measure = name, tuple(inputs), outputs, measure

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.outputs.split(",")]


class Registry:
    def __init__(self):
        self._known: dict[str, Provider] = {}

    def add(self, provider: Provider) -> Provider:
        if provider.name in self._known:
            raise ValueError(f"two providers are named {provider.name}")
        self._known[provider.name] = provider
        return provider

    def get(self, name: str) -> Provider:
        if name not in self._known:
            raise KeyError(f"no provider {name}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def chain(self, *names: str) -> list[Provider]:
        return [self.get(n) for n in names]


def apply_chain(df: DataFrame, key: str, providers: Sequence[Provider]) -> DataFrame:
    """key, the outputs, provider (the first that did the row) and reasons (of those that failed).

    A provider that raises on a batch is asked row by row, so one bad row costs no other its features; errors are data
    here and fail no task. All providers of a chain give the same outputs.
    """
    first = providers[0]
    if any(p.outputs != first.outputs for p in providers):
        raise ValueError("the providers of a chain give different outputs")
    names = first.columns()
    inputs = list(dict.fromkeys([key, *[c for p in providers for c in p.inputs]]))

    def measured(provider: Provider, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
        """The features, null where it failed, and why."""
        try:
            out = provider.measure(rows[list(provider.inputs)])
            return out[names].set_index(rows.index), pd.Series(None, rows.index, dtype=object)
        except Exception as error:  # noqa: BLE001  (any failure of a plugin is a row without features)
            if len(rows) == 1:
                return pd.DataFrame(None, rows.index, names, dtype=object), pd.Series(f"{provider.name}:{type(error).__name__}", rows.index, dtype=object)
            parts = [measured(provider, rows.iloc[i : i + 1]) for i in range(len(rows))]
            return pd.concat([p for p, _ in parts]), pd.concat([r for _, r in parts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame(None, rows.index, names, dtype=object)
            done, reasons = pd.Series(None, rows.index, dtype=object), pd.Series([[] for _ in range(len(rows))], rows.index)
            for provider in providers:
                left = rows[done.isna()]
                if not len(left):
                    break
                values, why = measured(provider, left)
                good = values.notna().all(axis=1)
                out.loc[values.index[good], names] = values.loc[good, names].astype(object)
                done[values.index[good]] = provider.name
                for i in values.index[~good]:
                    reasons[i] = reasons[i] + [why[i] if isinstance(why[i], str) else f"{provider.name}:NO_VALUE"]
            yield pd.concat([rows[[key]], out, done.rename("provider"), reasons.rename("reasons")], axis=1)

    kind = df.schema[key].dataType.simpleString()
    return df.select(*inputs).mapInPandas(run, f"`{key}` {kind}, {first.outputs}, provider string, reasons array<string>")


# X03
def fuse_components(rows: DataFrame, key: str, metric: str, value: str, confidence: str) -> DataFrame:
    """key, metric, value (weighted by confidence over the components that measured it), confidence (mean), components."""
    w = F.when(F.col(value).isNotNull(), F.greatest(F.col(confidence), F.lit(0.0)))
    total = F.sum(w)
    return rows.groupBy(key, metric).agg(F.when(total > 0, F.sum(F.col(value) * w) / F.nullif(total, F.lit(0.0))).alias(value), F.avg(w).alias(confidence), F.count(value).alias("components"))
