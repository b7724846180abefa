"""Attribute selection over groups of attributes that go together.

Attributes are the nodes of a graph, joined where their correlation reaches a threshold. Correlations and relevances are each
one job over the rows; the graph has as many nodes as the table has columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .selection import correlations, memoised


@dataclass
class Groups:
    """Each attribute's neighbours with itself (of those that stay), the attributes by falling relevance, and those that another makes needless."""

    members: dict[str, set[str]]
    order: list[str]
    needless: set[str]


def correlation_groups(df: DataFrame, columns: list[str], target: str, threshold: float = 0.8, cutoff: float = 1.0) -> Groups:
    """Groups by absolute correlations of at least ``threshold`` (a negative one: 0.85 times the greatest); the relevance of an
    attribute is its own with the target.

    Attributes are gone through by relevance to nine digits, of equal ones the first. One that correlates with an earlier one by ``cutoff``
    is needless: it opens no group and is in no later one. Nulls and constant columns correlate as 0.
    """
    table = correlations(df, columns, target)
    near = lambda a, b: 1.0 if a == b else min(1.0, table.get((a, b), table.get((b, a), 0.0)))
    if threshold < 0:
        threshold = 0.85 * max([near(a, b) for a in columns for b in columns if a != b], default=1.0)
    order = sorted(columns, key=lambda c: (-round(table[(c, target)], 9), columns.index(c)))
    needless: set[str] = set()
    members: dict[str, set[str]] = {}
    for a in order:
        if a in needless:
            continue
        members[a] = {a}
        for b in columns:
            if b not in needless and b != a and near(a, b) >= threshold:
                if near(a, b) >= cutoff:
                    needless.add(b)
                else:
                    members[a].add(b)
    return Groups(members, order, needless)


def grouped_forward(columns: list[str], groups: Groups, merit: Callable[[frozenset], float], relevance: dict[str, float] | None = None, spread: bool = True, enough: float | None = None, prune: bool = False) -> list[str]:
    """Adds attributes while the merit doesn't fall, trying one of each group a step instead of all.

    A step goes through the attributes by relevance; of an attribute's group the most relevant one that is still free is
    tried, and the group's others are left out of the step. The last of the best is added, and if ``spread`` its group isn't
    tried again. It ends where nothing is tried or as good, or at ``enough`` (the merit of all attributes if None).
    ``prune`` then drops attributes without which the merit stays there.
    """
    merit = memoised(merit)
    rank = {c: -i for i, c in enumerate(groups.order)} if relevance is None else relevance
    whole = merit(frozenset(columns)) if enough is None else enough
    chosen: list[str] = []
    closed, best = set(groups.needless), float("-inf")
    while True:
        avoid, found = set(closed), None
        for a in groups.order:
            if a in chosen or a in avoid:
                continue
            free = [c for c in columns if c in groups.members[a] and c not in chosen and c not in avoid]
            pick = max(free, key=lambda c: (rank[c], -columns.index(c)))
            if len(groups.members[a]) > 1:
                avoid |= set(free)
            value = merit(frozenset([*chosen, pick]))
            if value >= best:
                best, found = value, pick
        if found is None:
            break
        chosen.append(found)
        if spread:
            closed |= groups.members.get(found, set())
        if best == whole:
            break
    if prune:
        for a in [c for c in columns if c in chosen]:
            rest = frozenset(c for c in chosen if c != a)
            if whole and rest and merit(rest) == whole:
                chosen.remove(a)
    return chosen
