"""Coordination: sockpuppets, synchronised posting, clusters, brigading and vote manipulation."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .fingerprints import pairs


def sockpuppets(d: Dialect, overall: float, temporal: float, similar_pairs: str | None = None) -> str:
    """CTEs up to ``puppets``: similar pairs that never replied to each other.

    ``similar_pairs`` names a relation (author1, author2, overall, temporal, vocabulary) of these pairs, where it is computed already.
    """
    if similar_pairs:
        return f"puppets as (select author1, author2, overall * 0.4 + temporal * 0.35 + vocabulary * 0.25 as confidence, overall, temporal, vocabulary from {similar_pairs})"
    return f"""{pairs(d)}, met as (select src, dst from {d.edges} union select dst, src from {d.edges}),
        puppets as (select author1, author2, overall * 0.4 + temporal * 0.35 + vocabulary * 0.25 as confidence, overall, temporal, vocabulary from sim
        where overall >= {d.lit(overall)} and temporal >= {d.lit(temporal)} and not exists (select 1 from met where met.src = sim.author1 and met.dst = sim.author2))"""


@operator("co_sockpuppets", overall=0.6, temporal=0.1)
def co_sockpuppets(d: Dialect, overall: float = 0.85, temporal: float = 0.8, k: int = 50, similar_pairs: str | None = None) -> str:
    return f"""with {sockpuppets(d, overall, temporal, similar_pairs)} select author1, author2, round(confidence, 4) as confidence, round(overall, 4) as overall, round(temporal, 4) as temporal, round(vocabulary, 4) as vocabulary
        from puppets order by puppets.confidence desc, author1, author2 limit {int(k)}"""


@operator("co_sock_network", overall=0.6, temporal=0.1, least=0.5)
def sock_network(d: Dialect, overall: float = 0.85, temporal: float = 0.8, least: float = 0.7, k: int = 100, similar_pairs: str | None = None) -> str:
    return f"""with {sockpuppets(d, overall, temporal, similar_pairs)}, e as (select * from puppets where confidence >= {d.lit(least)} order by confidence desc, author1, author2 limit {int(k)})
        select 'edge' as kind, author1 as a, author2 as b, round(confidence, 4) as weight from e union all select distinct 'node', n, '', 0.0 from (select author1 as n from e union select author2 from e) x"""


@operator("co_brigading")
def brigading(d: Dialect, least: int = 5) -> str:
    """Rate, outsiders and regular gaps of the comments on every post with enough of them.

    Outsiders are distinct commenters; their share is tested against all comments and reported against distinct ones.
    """
    return f"""with c as (select c.post_id, c.author_name, {d.micros('c.created_at')} / 1.0e6 as t, c.id from {d.comments} c where c.author_name is not null),
        gaps as (select post_id, t - lag(t) over (partition by post_id order by t, id) as gap from c),
        g as (select post_id, avg(gap) as mean_gap, stddev_pop(gap) as std_gap from gaps where gap is not null group by post_id),
        s as (select post_id, count(*) as n, count(distinct author_name) as people, (max(t) - min(t)) / 3600 as hours from c group by post_id having count(*) >= {d.lit(least)}),
        own as (select author_name, submolt, count(*) as n from {d.posts} where author_name is not null group by author_name, submolt), total as (select author_name, count(*) as n from {d.posts} group by author_name),
        o as (select x.post_id, count(*) as outsiders from (select distinct c.post_id, c.author_name, p.submolt from c join {d.posts} p on p.id = c.post_id where p.submolt is not null) x
            join total t on t.author_name = x.author_name left join own w on w.author_name = x.author_name and w.submolt = x.submolt where coalesce(w.n, 0) * 1.0 / t.n < 0.1 group by x.post_id),
        f as (select s.post_id, s.n, s.people, s.hours, case when s.hours > 0 then s.n / s.hours else s.n * 1.0 end as rate, coalesce(o.outsiders, 0) as outsiders, g.std_gap < g.mean_gap * 0.5 as burst
            from s join g on g.post_id = s.post_id left join o on o.post_id = s.post_id)
        select post_id, signals >= 2 as likely, round(signals / 3.0, 4) as confidence, round(rate, 2) as rate, people, round(outsiders * 1.0 / people, 2) as outsider_ratio, burst from (
        select *, (case when rate > 5 then 1 else 0 end) + (case when outsiders > n * 0.5 then 1 else 0 end) + (case when burst then 1 else 0 end) as signals from f) y"""


@operator("co_vote_manip")
def vote_manipulation(d: Dialect, hours: float = 168, least: int = 10, k: int = 30) -> str:
    return f"""with p as (select id, substr(title, 1, 80) as title, author_name, upvotes, comment_count, upvotes * 1.0 / nullif(comment_count, 0) as ratio, upvotes / greatest({d.days(d.now, 'created_at')} * 24, 0.1) as speed
            from {d.posts} where upvotes >= {d.lit(least)} and created_at > {d.ago(hours)} order by ratio desc nulls last, id limit 50),
        s as (select *, (case when coalesce(ratio, 0) > 10 then 1 else 0 end) + (case when speed > 5 then 1 else 0 end) + (case when coalesce(comment_count, 0) = 0 then 1 else 0 end) as signals from p where ratio is null or ratio = 0 or ratio >= 5)
        select id, title, author_name, upvotes, comment_count, round(ratio, 2) as ratio, round(speed, 2) as upvotes_per_hour, signals from s order by signals desc, s.ratio desc nulls last, id limit {int(k)}"""
