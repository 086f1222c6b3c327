"""Box arithmetic as SQL expressions. A box is named by a prefix or alias: columns x, y, x2, y2, origin bottom left."""

from __future__ import annotations


def area(a: str) -> str:
    return f"(greatest(0, {a}.x2 - {a}.x) * greatest(0, {a}.y2 - {a}.y))"


def shared(a: str, b: str) -> str:
    """Area of the intersection."""
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y, {b}.y)))"


def meets(a: str, b: str) -> str:
    """Whether two boxes share an area."""
    return f"({a}.x < {b}.x2 AND {b}.x < {a}.x2 AND {a}.y < {b}.y2 AND {b}.y < {a}.y2)"


def inside(a: str, b: str) -> str:
    """Share of a's area that lies in b; 0 for an empty box."""
    return f"(CASE WHEN {area(a)} > 0 THEN {shared(a, b)} / CAST({area(a)} AS DOUBLE) ELSE 0.0 END)"


def union_area(a: str, b: str) -> str:
    return f"({area(a)} + {area(b)} - {shared(a, b)})"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {union_area(a, b)} > 0 THEN {shared(a, b)} / CAST({union_area(a, b)} AS DOUBLE) ELSE 0.0 END)"
