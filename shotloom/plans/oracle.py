"""Common table expressions for the check queries."""

from __future__ import annotations

import re

from ..sources.views import SHOTS_SQL

CTES: dict[str, str] = {
    "sig": """SELECT user_id AS series_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
        (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS v, event_type AS kind, event_id FROM events""",
    "shots": re.sub(r"(\d)D\b", r"\1::DOUBLE", SHOTS_SQL.replace("{lineitem}", "lineitem")).replace(
        "datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01')", "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"),
    "beats": "SELECT series_id, t AS beat FROM sig WHERE kind = 'click'",
    "cuts": "SELECT series_id, event_id, t AS cut FROM sig WHERE kind = 'purchase'",
    "win": "SELECT series_id, t AS w_start, t + v * 60 AS w_end FROM sig WHERE kind = 'signup'",
    "clip": "SELECT series_id, event_id AS clip_id, t AS c_in, t + 3600 AS c_out FROM sig WHERE kind = 'purchase'",
}


def _needs(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b(FROM|JOIN|from|join)\s+{n}\b|,\s*{n}\b(?=\s*(?:\w+\s*)?(?:WHERE|,|\)|$))", text)]


def sql(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """A check query: shared expressions it mentions, then ``extra`` ones, then ``body``."""
    own = [n for n, _ in extra]
    text = "\n".join([body, *[s for _, s in extra]])
    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in _needs(CTES[name]):
            if dep != name:
                add(dep)
        if name not in wanted:
            wanted.append(name)

    for n in _needs(text):
        if n not in own:
            add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in wanted]
    parts += [f"{n} AS ({s})" for n, s in extra]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r6(x: str) -> str:
    return f"(round(({x}) + 1e-10, 6) + 0.0)"
