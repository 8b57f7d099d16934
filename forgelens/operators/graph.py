"""The dependency graph, kept as degrees.

Every runtime dependency of a repository points at every other dependency of it. The graph is a
complete bipartite one, so two counts per repository describe all edges; the pairs themselves are
never produced. The neighbours of one dependency are a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgelens.functions.sql import exprs, lit
from forgelens.operators.dependencies import risk_score
from forgelens.operators.skew import join_hot
from forgelens.tables import per_repo

SIDES = {"runtimes": "count_if(dep_type = 'runtime')", "others": "count_if(dep_type <> 'runtime')"}


def graph_size(repos: DataFrame, deps: DataFrame) -> DataFrame:
    sizes = deps.groupBy("repo").agg(
        *exprs(nodes="count(*)", edges=f"{SIDES['runtimes']} * {SIDES['others']}")
    )
    return per_repo(repos, sizes, zeros={"nodes": 0, "edges": 0})


def graph_nodes(deps: DataFrame) -> DataFrame:
    """Nodes with their degrees and risk."""
    sides = deps.groupBy("repo").agg(*exprs(**SIDES))
    return join_hot(deps, sides, ["repo"], ["name"]).select(
        "repo",
        "name",
        "dep_type",
        *exprs(
            dependencies="if(dep_type = 'runtime', others, 0L)",
            dependents="if(dep_type = 'runtime', 0L, runtimes)",
            risk_score=risk_score(),
        ),
    )


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("dependencies = 0").select("repo", "name")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("dependents = 0").select("repo", "name")


def dependencies_of(deps: DataFrame, repo: str, name: str) -> DataFrame:
    """Direct dependencies of one node: the other side of its repository, if it is runtime."""
    return _neighbours(deps, repo, name, "=", "<>")


def dependents_of(deps: DataFrame, repo: str, name: str) -> DataFrame:
    return _neighbours(deps, repo, name, "<>", "=")


def _neighbours(deps: DataFrame, repo: str, name: str, own: str, other: str) -> DataFrame:
    mine = deps.where(f"repo = {lit(repo)}")
    node = mine.where(f"name = {lit(name)} AND dep_type {own} 'runtime'").select("repo")
    opposite = mine.where(f"dep_type {other} 'runtime'")
    return opposite.join(node, "repo", "left_semi").select("repo", "name")
