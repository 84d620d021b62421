"""Alerts: rules that turn findings into alerts, duplicates, lists, and risk scores."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .coordination import sockpuppets
from .insights import alert_counts
from .temporal import bursts

# Weights of severities and types in a risk score.
SEVERITY = [("critical", 4.0), ("high", 3.0), ("medium", 2.0), ("low", 1.0)]
TYPES = [("sockpuppet", 3.0), ("synchronized_posting", 2.5), ("narrative_push", 3.0), ("coordination_cluster", 2.0), ("bot_farm", 3.0), ("behavior_change", 1.5), ("activity_burst", 1.0)]


@operator("al_sockpuppet", overall=0.6, temporal=0.1)
def al_sockpuppet(d: Dialect, overall: float = 0.85, temporal: float = 0.8, similar_pairs: str | None = None) -> str:
    return f"with {sockpuppets(d, overall, temporal, similar_pairs)} select 'sockpuppet' as alert_type, author1, author2, case when confidence >= 0.9 then 'high' when confidence >= 0.8 then 'medium' else 'low' end as severity, round(confidence, 4) as confidence from puppets"


def graded(d: Dialect, source: str, kind: str, grades: list[tuple[str, str]], confidence: str) -> str:
    """Alerts of the rows that reach a grade: (condition, severity) in order."""
    whens = " ".join(f"when {c} then {d.lit(s)}" for c, s in grades)
    return f"select * from (select {d.lit(kind)} as alert_type, x.*, case {whens} end as severity, round({confidence}, 4) as confidence from ({source}) x) y where severity is not null"


@operator("al_burst", z=1.0, low=1.5, high=2.0, days=14)
def al_burst(d: Dialect, z: float = 3.0, low: float = 4, high: float = 5, days: int = 7) -> str:
    source = f"select first_hour, last_hour, peak_hour, peak_activity, round(z, 3) as z from b"
    body = graded(d, source, "activity_burst", [(f"z > {d.lit(high)}", "high"), (f"z > {d.lit(low)}", "medium")], "least(greatest((z - 3) / 3, 0), 1.0)")
    return f"with {bursts(d, z, days)} {body}"


@operator("al_behavior", threshold=0.05, medium=0.4)
def al_behavior(d: Dialect, threshold: float = 0.5, medium: float = 0.7) -> str:
    from .fingerprints import change

    return f"select 'behavior_change' as alert_type, author_name, case when max(delta) >= {d.lit(medium)} then 'medium' else 'low' end as severity, round(max(delta), 4) as max_delta, count(*) as changes from ({change(d, threshold)}) c group by author_name"


@operator("al_dup_check")
def dup_check(d: Dialect, hours: float = 24, least: float = 0.7) -> str:
    """Alerts that repeat an earlier active one of the same type with nearly the same authors."""
    a, b = "n.involved_authors", "o.involved_authors"
    return f"""select distinct n.id from {d.alerts} n join {d.alerts} o on o.alert_type = n.alert_type and o.id < n.id where o.status = 'active' and {d.micros('n.detected_at')} - {d.micros('o.detected_at')} between 0 and {int(hours * 3.6e9)}
        and {d.overlap(a, b)} * 1.0 / {d.all_of(a, b)} > {d.lit(least)}"""


@operator("al_active", severity="high")
def active(d: Dialect, severity: str | None = None, alert_type: str | None = None, k: int = 50) -> str:
    more = "".join(f" and {c} = {d.lit(v)}" for c, v in (("severity", severity), ("alert_type", alert_type)) if v is not None)
    return f"select id, alert_type, severity, confidence, detected_at from {d.alerts} where status = 'active'{more} order by detected_at desc, id limit {int(k)}"


operator("al_summary")(alert_counts)


@operator("al_resolve", alert_id=12)
def resolve(d: Dialect, alert_id: int = -1, notes: str = "") -> str:
    """The alerts with one of them resolved."""
    hit = f"id = {d.lit(alert_id)}"
    return f"select id, case when {hit} then 'resolved' else status end as status, case when {hit} then {d.lit(notes)} end as resolution_notes from {d.alerts}"


def by_author(d: Dialect, most: int = 20) -> str:
    """Each author's latest alerts."""
    return f"""select * from (select author, id, alert_type, severity, confidence, detected_at, status, row_number() over (partition by author order by detected_at desc, id desc) as r from (
        select {d.explode('involved_authors')} as author, id, alert_type, severity, confidence, detected_at, status from {d.alerts}) x) y where r <= {int(most)}"""


@operator("al_history", author="u7")
def history(d: Dialect, author: str | None = None, k: int = 20) -> str:
    own = "" if author is None else f" where author = {d.lit(author)}"
    return f"select author, id, alert_type, severity, detected_at, status from ({by_author(d, k)}) h{own}"


def risk(d: Dialect) -> str:
    sev = "case severity " + " ".join(f"when '{k}' then {v}" for k, v in SEVERITY) + " else 1.0 end"
    typ = "case alert_type " + " ".join(f"when '{k}' then {v}" for k, v in TYPES) + " else 1.0 end"
    return f"""select author, least(sum(case when status = 'resolved' then 0.0 else {sev} * {typ} / (1 + 0.1 * floor({d.days(d.now, 'detected_at')})) * confidence end) * 10, 100.0) as score, count(case when status = 'active' then 1 end) as alerts,
        count(distinct case when status = 'active' then alert_type end) as types from ({by_author(d)}) h group by author"""


def levelled(source: str) -> str:
    return f"select author, round(score, 1) as risk_score, case when score >= 70 then 'critical' when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end as risk_level, alerts, types from ({source}) r"


@operator("al_risk")
def al_risk(d: Dialect, author: str | None = None) -> str:
    own = "" if author is None else f" where author = {d.lit(author)}"
    return f"select * from ({levelled(risk(d))}) z{own}"


@operator("al_high_risk")
def high_risk(d: Dialect, k: int = 30) -> str:
    return f"{levelled(risk(d))} where score > 0 order by score desc, author limit {int(k)}"
