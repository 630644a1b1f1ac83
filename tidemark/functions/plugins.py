"""Registries of user-made labels and features, as functions from DataFrame to DataFrame.

A label is used with df.transform(labels.get(name, **parameters)). A feature node names its inputs and outputs;
apply() adds the nodes that are asked for after those whose outputs they need, and only these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

Transform = Callable[..., DataFrame]


class Labels:
    def __init__(self):
        self._known: dict[str, Transform] = {}

    def add(self, name: str, build: Transform) -> Transform:
        self._known[name] = build
        return build

    def get(self, name: str, **parameters) -> Callable[[DataFrame], DataFrame]:
        if name not in self._known:
            raise KeyError(f"no label {name}; known: {sorted(self._known)}")
        return partial(self._known[name], **parameters) if parameters else self._known[name]


@dataclass(frozen=True)
class Node:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    build: Transform


class Features:
    def __init__(self):
        self._nodes: dict[str, Node] = {}

    def add(self, name: str, inputs: tuple[str, ...], outputs: tuple[str, ...], build: Transform) -> None:
        self._nodes[name] = Node(inputs, outputs, build)

    def order(self, wanted: list[str], given: list[str]) -> list[str]:
        """The nodes to run, each after those it needs; a circle or an input that nothing gives is an error."""
        makers = {c: n for n, node in self._nodes.items() for c in node.outputs}
        done: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"features need each other: {' -> '.join([*above, name])}")
            if name in done:
                return
            for c in self._nodes[name].inputs:
                if c not in given:
                    if c not in makers:
                        raise ValueError(f"MISSING_FEATURE: {c}, for {name}")
                    visit(makers[c], (*above, name))
            done.append(name)

        for name in wanted:
            visit(name, ())
        return done

    def apply(self, df: DataFrame, wanted: list[str]) -> DataFrame:
        for name in self.order(wanted, df.columns):
            df = df.transform(self._nodes[name].build)
        return df
