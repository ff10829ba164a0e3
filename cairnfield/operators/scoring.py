"""Scores, levels and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .history import score_level

#: Fixed value: parts of a path that mark it as touching security.
SECURITY_WORDS = ("auth", "login", "crypt", "token", "password", "key", "permission", "session", "guard", "jwt", "policy", "security")


def half_up(x: Column) -> Column:
    """rounds halves upwards."""
    return F.floor(x + 0.5)


def hotspot_score(commits: Column, authors: Column, days: Column, reverts: Column, role: Column, rank: Column, files: Column, entry_weight: Column | None = None, compat: bool = False) -> Column:
    """R1. Nulls count as nothing; with compat a file without history counts one author and is as fresh as can be."""
    weight = F.lit(1.0) if entry_weight is None else entry_weight
    fresh = F.greatest(F.lit(0), 30 - (F.coalesce(days, F.lit(0)) if compat else F.coalesce(days, F.lit(30)))) * 0.5
    base = F.least(F.coalesce(commits, F.lit(0)), F.lit(10)) * 2 + F.coalesce(authors, F.lit(1 if compat else 0)) * 3 + fresh + F.coalesce(reverts, F.lit(0)) * 5
    score = F.when(role == "config", F.floor(base * 0.3)).otherwise(base)
    score = F.when(weight > 1, F.floor(score * weight)).otherwise(score)
    score = F.when(rank > 2.0 / files, F.floor(score * 1.1)).otherwise(score)
    alone = F.least(half_up(rank * 100), F.lit(100))
    score = F.when((F.coalesce(commits, F.lit(0)) == 0) & (score == 0) & (rank > 0), alone).otherwise(score)
    out = F.least(half_up(score), F.lit(100)).cast("long")
    return F.when(commits.isNull() & (F.coalesce(rank, F.lit(0.0)) == 0), F.lit(0).cast("long")).otherwise(out)


def stability_score(has_tests: Column, dependents: Column, mainline: Column, in_cycle: Column, role: Column) -> Column:
    """R3, F16."""
    s = F.lit(45) + F.when(has_tests, 15).otherwise(0) + F.when(dependents < 5, 15).when(dependents > 20, -10).otherwise(0)
    s = s + F.when(mainline, 0).otherwise(-10) + F.when(in_cycle, -15).otherwise(0) + F.when(role == "config", 5).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), s))


def stability_level(score: Column) -> Column:
    """R4."""
    return F.when(score >= 70, "stable").when(score >= 40, "moderate").otherwise("fragile")


def composite_risk(entry: Column, routes: Column, prefixes: Column, tests: Column, impact: Column, path: Column, mainline: Column) -> dict[str, Column]:
    """Score, level and the five dimensions."""
    d = {
        "flow": F.when(entry, 3).when(routes >= 5, 2).when(routes >= 1, 1).otherwise(0),
        "crossing": F.least(prefixes, F.lit(3)).cast("int"),
        "test_gap": F.when((tests == 0) & (impact >= 3), 3).when((tests == 0) & (impact > 0), 2).when(tests.isin(1, 2), 1).otherwise(0),
        "callers": F.when(impact >= 10, 3).when(impact >= 5, 2).when(impact >= 1, 1).otherwise(0),
        "security": F.when(F.lower(path).rlike("|".join(SECURITY_WORDS)), 2).otherwise(0),
    }
    total = sum(d.values(), F.lit(0))
    score = F.greatest(F.lit(0), total - F.when(mainline, 0).otherwise(1))
    return d | {"score": score, "level": score_level(score)}


def file_severity(impact: Column, tests: Column) -> Column:
    return F.when((impact >= 10) | (tests >= 5), "high").when((impact >= 1) | (tests >= 1), "medium").otherwise("low")


def repo_severity(unresolved: Column, cycles: Column, dead: Column, missing: Column) -> Column:
    return F.when((unresolved >= 1) | (cycles >= 1), "high").when((dead >= 1) | (missing >= 3), "medium").otherwise("low")


def overview_severity(unresolved: Column, cycles: Column, fragile: Column, dead: Column, orphans: Column) -> Column:
    return F.when((unresolved >= 1) | (cycles >= 1), "high").when((fragile >= 1) | (dead >= 1) | (orphans >= 5), "medium").otherwise("low")


def diff_severity(high_files: Column, tests: Column, high_history: Column, high_composite: Column, mainline: Column, impact: Column, history: Column, composite: Column) -> Column:
    high = (high_files > 0) | (tests >= 5) | (high_history > 0) | (high_composite > 0)
    medium = (mainline > 0) & ((tests > 0) | (impact >= 1) | (history >= 3) | (composite >= 3))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


#: Ranks of severities, and of data qualities from best to worst.
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
QUALITY = ("certain", "degraded", "unavailable")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def worst_quality(*qualities: Column) -> Column:
    """A result is as good as its worst input; unknown ones count as unavailable."""
    ranks = [F.when(q == QUALITY[0], 0).when(q == QUALITY[1], 1).otherwise(2) for q in qualities]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.element_at(F.array(*map(F.lit, QUALITY)), top + 1)


def trend(now: Column, base: Column) -> Column:
    """A tenth up or down counts; a new file grows."""
    return F.when(base.isNull(), "GROWING").when(now.isNull(), "STABLE").when(now >= base * 1.1, "GROWING").when(now <= base * 0.9, "SHRINKING").otherwise("STABLE")
