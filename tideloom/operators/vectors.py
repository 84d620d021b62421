"""Vector search and similarity over stored embeddings."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .relational import positions


def content_of(d: Dialect) -> str:
    """Embedded content of either kind with its text."""
    return f"""select e.content_id, e.content_type, e.embedding, coalesce(p.title, '') as title, coalesce(p.content, c.content) as content, coalesce(p.author_name, c.author_name) as author_name, coalesce(p.created_at, c.created_at) as created_at
        from {d.embs} e left join {d.posts} p on e.content_id = p.id and e.content_type = 'post' left join {d.comments} c on e.content_id = c.id and e.content_type = 'comment'"""


def query_vector(d: Dialect, content_id: int) -> str:
    return f"(select embedding as q from {d.embs} where content_id = {d.lit(content_id)})"


def ranked(d: Dialect, content_id: int, content_type: str | None, despam: bool, dedup: bool) -> str:
    """Content by similarity to a stored vector, without spam, the best of each text."""
    where = ["v.content <> ''"] + ([f"v.content_type = {d.lit(content_type)}"] if content_type else [])
    if despam:
        where.append(f"not exists (select 1 from {d.spam_scores} s where s.content_id = v.content_id and s.spam_score >= 50)")
    key = f"lower({d.join_array(d.split_space('substr(' + d.replace_all('content', '^\\s+|\\s+$', '') + ', 1, 200)'), ' ')})"
    scored = f"select v.*, {d.cosine('v.embedding', 'q.q')} as s from ({content_of(d)}) v cross join {query_vector(d, content_id)} q where {' and '.join(where)}"
    if not dedup:
        return f"select *, 1 as r from ({scored}) y"
    return f"select * from (select *, row_number() over (partition by {key} order by s desc, content_id) as r from ({scored}) y) z where r = 1"


@operator("vx_search", content_id=7)
def search(d: Dialect, content_id: int = 0, content_type: str | None = None, despam: bool = True, k: int = 10) -> str:
    """Nearest content: spam goes first, then copies, then the k best are cut."""
    return f"select content_id, content_type, title, substr(content, 1, 500) as content, author_name, round(s, 4) as similarity from ({ranked(d, content_id, content_type, despam, True)}) x order by s desc, content_id limit {int(k)}"


@operator("vx_search_cli", content_id=7)
def search_cli(d: Dialect, content_id: int = 0, k: int = 10) -> str:
    return f"select content_id, substr(case when title <> '' then title else content end, 1, 200) as text, round(s, 4) as similarity from ({ranked(d, content_id, None, False, False)}) x order by s desc, content_id limit {int(k)}"


@operator("vx_export", content_id=7)
def export(d: Dialect, content_id: int = 0, content_type: str | None = None, k: int = 100) -> str:
    return f"select content_id, content_type, title, substr(content, 1, 1000) as content, author_name, round(s, 4) as similarity from ({ranked(d, content_id, content_type, True, True)}) x order by s desc, content_id limit {int(k)}"


@operator("vx_similar", content_id=7)
def similar(d: Dialect, content_id: int = 0, k: int = 5) -> str:
    return f"""select p.id, substr(p.title, 1, 60) as title, p.author_name, round({d.cosine('e.embedding', 'q.q')}, 4) as similarity from {d.embs} e join {d.posts} p on p.id = e.content_id cross join {query_vector(d, content_id)} q
        where e.content_id <> {d.lit(content_id)} order by {d.cosine('e.embedding', 'q.q')} desc, p.id limit {int(k)}"""


@operator("vx_trends", content_id=7, threshold=0.2)
def trends(d: Dialect, content_id: int = 0, threshold: float = 0.6) -> str:
    return f"select p.id, p.created_at, round({d.cosine('e.embedding', 'q.q')}, 4) as similarity from {d.embs} e join {d.posts} p on p.id = e.content_id cross join {query_vector(d, content_id)} q where {d.cosine('e.embedding', 'q.q')} > {d.lit(threshold)}"


@operator("vx_author_sim", author1="u1", author2="u2")
def author_sim(d: Dialect, author1: str = "", author2: str = "") -> str:
    rows = positions(d, f"(select p.author_name, e.embedding from {d.embs} e join {d.posts} p on p.id = e.content_id where p.author_name in ({d.lit(author1)}, {d.lit(author2)})) s", "author_name")
    return f"""with m as (select author_name, ix, avg(v) as v, count(*) as n from ({rows}) r group by author_name, ix),
        a as (select * from m where author_name = {d.lit(author1)}), b as (select * from m where author_name = {d.lit(author2)})
        select round(sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0), 4) as similarity, max(a.n) as posts1, max(b.n) as posts2 from a join b on a.ix = b.ix"""
