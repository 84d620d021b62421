"""Sparse labelled matrices in long form: (row, column, value)."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .relational import hour_of_week


@operator("mx_interaction")
def interaction(d: Dialect) -> str:
    return f"select src as row_label, dst as col_label, w as value from {d.edges}"


def temporal(d: Dialect) -> str:
    """Share of each hour of the week in an author's activity."""
    return f"""select author_name, how, n * 1.0 / sum(n) over (partition by author_name) as share, n from (select author_name, {hour_of_week(d)} as how, count(*) as n from {d.activity} where author_name is not null group by author_name, {hour_of_week(d)}) x"""


@operator("mx_temporal")
def mx_temporal(d: Dialect) -> str:
    return f"select author_name as row_label, how as col_label, round(share, 6) as value from ({temporal(d)}) t"


@operator("mx_content_sim", threshold=0.3)
def content_sim(d: Dialect, threshold: float = 0.7, cosines: str | None = None) -> str:
    """Symmetric similarities of posts at or above the threshold, without the diagonal; all posts take part.

    ``cosines`` names a relation (x, y, s) of such pairs, where it is computed already.
    """
    pairs = f"select a.content_id as x, b.content_id as y, {d.cosine('a.embedding', 'b.embedding')} as s from {d.embs} a join {d.embs} b on a.content_id < b.content_id"
    source = f"select x, y, s from {cosines}" if cosines else pairs
    return f"""with s as ({source})
        select x as row_label, y as col_label, round(s, 4) as value from s where s >= {d.lit(threshold)} union all select y, x, round(s, 4) from s where s >= {d.lit(threshold)}"""


@operator("mx_incremental")
def incremental(d: Dialect) -> str:
    """Counts of a stored matrix and of new interactions, added up by label."""
    return f"select row_label, col_label, sum(value) as value from (select src as row_label, dst as col_label, w as value from {d.edges} union all select src, dst, 1 from {d.edges} where w > 1 union all select 'new', dst, 1 from {d.edges} where w > 1) u group by row_label, col_label"


@operator("mx_row_interaction", author="u5")
def row_interaction(d: Dialect, author: str = "") -> str:
    return f"select 'out' as side, dst as label, w as value from {d.edges} where src = {d.lit(author)} union all select 'in', src, w from {d.edges} where dst = {d.lit(author)}"


@operator("mx_row_temporal", author="u5")
def row_temporal(d: Dialect, author: str = "") -> str:
    return f"select how, round(share, 6) as value from ({temporal(d)}) t where author_name = {d.lit(author)}"


@operator("mx_similar_content", content_id=7, threshold=0.2)
def similar_content(d: Dialect, content_id: int = 0, threshold: float = 0.7, k: int = 10) -> str:
    """The true k nearest of a post (the matrix has no diagonal, so nothing is skipped)."""
    return f"select col_label, value from ({content_sim(d, threshold)}) m where row_label = {d.lit(content_id)} order by value desc, col_label limit {int(k)}"


def unit_product(d: Dialect, name: str, rows: str) -> str:
    """CTEs for cosines between the rows of a long matrix (author, k, v)."""
    return f"""{name}_n as (select author, sqrt(sum(v * v)) as norm from ({rows}) r group by author),
        {name}_u as (select r.author, r.k, r.v / nullif(n.norm, 0) as v from ({rows}) r join {name}_n n on n.author = r.author),
        {name}_c as (select a.author as x, b.author as y, sum(a.v * b.v) as s from {name}_u a join {name}_u b on a.k = b.k and a.author < b.author group by a.author, b.author)"""


def combined(d: Dialect, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, topics: str | None = None) -> str:
    """Weighted cosines of the interaction and temporal rows of authors that have both; all columns count.

    ``topics`` names a relation (author_name, topic, share) that adds its part; without one there is none.
    """
    inter = f"select src as author, dst as k, cast(w as double) as v from {d.edges}"
    temp = f"select author_name as author, how as k, cast(share as double) as v from ({temporal(d)}) t where author_name in (select src from {d.edges})"
    if topics:
        more = f"select author_name as author, topic as k, cast(share as double) as v from {topics}"
        return f"""with {unit_product(d, 'i', inter)}, {unit_product(d, 't', temp)}, {unit_product(d, 'p', more)}
            select t_c.x as author1, t_c.y as author2, {alpha} * coalesce(i_c.s, 0) + {beta} * t_c.s + {gamma} * coalesce(p_c.s, 0) as value from t_c
            left join i_c on i_c.x = t_c.x and i_c.y = t_c.y left join p_c on p_c.x = t_c.x and p_c.y = t_c.y"""
    return f"""with {unit_product(d, 'i', inter)}, {unit_product(d, 't', temp)}
        select t_c.x as author1, t_c.y as author2, {alpha} * coalesce(i_c.s, 0) + {beta} * t_c.s as value from t_c left join i_c on i_c.x = t_c.x and i_c.y = t_c.y"""


def community_shares(d: Dialect) -> str:
    """Each author's shares of communities: a topic matrix that is counted, not learned."""
    return f"(select author_name, submolt as topic, count(*) * 1.0 / sum(count(*)) over (partition by author_name) as share from {d.posts} where author_name is not null group by author_name, submolt) shares"


@operator("mx_combined", counted_topics=True)
def mx_combined(d: Dialect, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, topics: str | None = None, counted_topics: bool = False, pairs: str | None = None) -> str:
    """``topics`` names a learned topic matrix; ``counted_topics`` takes the shares of communities for one; ``pairs`` names a relation of the values, where they are computed already."""
    if pairs:
        return f"select author1, author2, round(value, 4) as value from {pairs}"
    topics = topics or (community_shares(d) if counted_topics else None)
    return f"select author1, author2, round(value, 4) as value from ({combined(d, alpha, beta, gamma, topics)}) c"
