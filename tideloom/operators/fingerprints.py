"""Behavioural fingerprints: temporal, vocabulary, interaction, style and engagement components of every author."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .matrices import temporal

# The vocabulary of the vocabulary component, in order.
VOCABULARY = """
the and that have for not with you this but
from they would there their what about which when one
can had were all your how been has more some
could into other than then now only just think know
agent model system data code user time people work way
make like use new good first need want get see
also well really should even most any much very still
actually something maybe right thing going will does being here
each own same different part point case question problem example
best long great little after things through back always between
""".split()
# First dimension of each component in the whole vector.
OFFSETS = {"temporal": 0, "vocabulary": 168, "topic": 268, "interaction": 288, "style": 298, "engagement": 313}


def fp_temporal(d: Dialect) -> str:
    return f"select author_name, how as dim, share as v from ({temporal(d)}) t"


def fp_vocab(d: Dialect, sums: str | None = None) -> str:
    """``sums`` names a relation (author_name, dim, n) of the words by author, those out of the vocabulary with no dim, where it is computed already."""
    words = d.values([(w, i) for i, w in enumerate(VOCABULARY)], ["w", "dim"])
    # every word is read once; at most a hundred and one sums an author go on
    sums = f"select * from {sums}" if sums else f"select t.author_name, v.dim, count(*) as n from (select author_name, {d.explode(d.tokens('content', 3, 15))} as word from {d.activity} where content is not null) t left join {words} v on v.w = t.word group by t.author_name, v.dim"
    return f"select author_name, dim, n * 1.0 / total as v from (select author_name, dim, n, sum(n) over (partition by author_name) as total from ({sums}) s) w where dim is not null and author_name is not null"


def long_of(names: list[str], source: str, d: Dialect) -> str:
    """Columns of a wide relation as rows (author_name, dim, v)."""
    picks = " ".join(f"when {i} then {name}" for i, name in enumerate(names))
    return f"select author_name, dim, cast(case dim {picks} end as double) as v from ({source}) w cross join (select {d.spine(0, len(names) - 1)} as dim) k"


def interaction_wide(d: Dialect) -> str:
    return f"""with a as (select author_name, count(case when kind = 'post' then 1 end) as posts, count(case when kind = 'comment' then 1 end) as comments from {d.activity} where author_name is not null group by author_name),
        o as (select c.author_name, count(distinct case when p.author_name <> c.author_name then p.author_name end) as others, count(case when p.author_name = c.author_name then 1 end) as selfs from {d.comments} c join {d.posts} p on p.id = c.post_id group by c.author_name),
        r as (select p.author_name, count(*) as received from {d.comments} c join {d.posts} p on p.id = c.post_id where c.author_name <> p.author_name group by p.author_name),
        th as (select author_name, avg(n) as per from (select author_name, post_id, count(*) as n from {d.comments} group by author_name, post_id) x group by author_name)
        select a.author_name, comments * 1.0 / (posts + comments) as d0, posts * 1.0 / (posts + comments) as d1, least(coalesce(others, 0) / 100.0, 1.0) as d2,
        least(coalesce(selfs, 0) * 1.0 / greatest(comments, 1), 1.0) as d3, least(coalesce(per, 0) / 10.0, 1.0) as d4, least(coalesce(received, 0) * 1.0 / greatest(posts, 1) / 10, 1.0) as d5,
        case when posts > 0 and comments > 0 then 1.0 else 0.0 end as d6, least(posts / 100.0, 1.0) as d7, least(comments / 200.0, 1.0) as d8, least((posts + comments) / 300.0, 1.0) as d9
        from a left join o on o.author_name = a.author_name left join r on r.author_name = a.author_name left join th on th.author_name = a.author_name"""


def fp_interaction(d: Dialect) -> str:
    return long_of([f"d{i}" for i in range(10)], interaction_wide(d), d)


def style_counts(d: Dialect) -> tuple[str, dict[str, str]]:
    """What is left of a text as its marks, and what is counted in it."""
    # one pass leaves the marks, capitals, emoji and digits, with a blank for each run of other characters; the rest reads that
    marks = d.replace_all("content", "[^.,?!\\n\\x22\\x27()0-9\\p{Lu}\U0001f300-\U0001f9ff]+", " ")
    few = {"dots": ["."], "commas": [","], "asks": ["?"], "shouts": ["!"], "breaks": ["\n"], "quotes": ['"', "'"], "parens": ["(", ")"]}
    rare = {"urls": ("://", ["http://", "https://"]), "fences": ("```", ["```"])}
    counts = {k: " + ".join(d.count_of("marks", text) for text in texts) for k, texts in few.items()}
    counts |= {k: f"case when content like {d.lit('%' + sign + '%')} then {' + '.join(d.count_of('content', text) for text in texts)} else 0 end" for k, (sign, texts) in rare.items()}
    counts |= {k: d.count_matches("marks", p) for k, p in {"caps": r"\p{Lu}", "emoji": "[\U0001f300-\U0001f9ff]", "numbers": "[0-9]+"}.items()} | {"lists": d.count_matches("content", r"(?m)^[-*0-9.]\s")}
    return marks, counts


def style_wide(d: Dialect, sums: str | None = None) -> str:
    """``sums`` names a relation of the sums by author, where it is computed already."""
    marks, counts = style_counts(d)
    totals = ", ".join(f"sum({count}) as {k}" for k, count in counts.items())
    own = f"""select author_name, count(*) as n, avg(length(content)) as mean_len, stddev_pop(length(content)) as std_len, sum(length(content)) as chars, {totals} from (select author_name, content, {marks} as marks from {d.activity} where content is not null and content <> '' and author_name is not null) m group by author_name"""
    t = "nullif(chars, 0)"
    # a list mark counts at the start of a line of the author's joined text, so that of each text but the first may follow a blank
    return f"""select author_name, least(mean_len / 1000, 1.0) as d0, case when n > 1 then least(std_len / 500, 1.0) else 0.0 end as d1,
        coalesce(least(dots * 100.0 / {t}, 1.0), 0) as d2, coalesce(least(commas * 100.0 / {t}, 1.0), 0) as d3, coalesce(least(asks * 100.0 / {t}, 1.0), 0) as d4, coalesce(least(shouts * 100.0 / {t}, 1.0), 0) as d5,
        coalesce(least(caps * 10.0 / {t}, 1.0), 0) as d6, least(urls * 1.0 / n, 1.0) as d7, least(fences * 1.0 / n, 1.0) as d8, least(emoji * 1.0 / n, 1.0) as d9, coalesce(least(breaks * 50.0 / {t}, 1.0), 0) as d10,
        coalesce(least(quotes * 100.0 / {t}, 1.0), 0) as d11, least(numbers * 1.0 / n, 1.0) as d12, coalesce(least(parens * 100.0 / {t}, 1.0), 0) as d13, least(lists * 1.0 / n, 1.0) as d14
        from ({f"select * from {sums}" if sums else own}) s"""


def fp_style(d: Dialect, sums: str | None = None) -> str:
    return long_of([f"d{i}" for i in range(15)], style_wide(d, sums), d)


def engagement_wide(d: Dialect) -> str:
    return f"""with a as (select distinct author_name from {d.activity} where author_name is not null),
        p as (select author_name, avg(upvotes) as au, avg(comment_count) as ac, max(upvotes) as hi, min(upvotes) as lo, count(*) as n, cast(floor({d.days('max(created_at)', 'min(created_at)')}) as bigint) + 1 as days from {d.posts} group by author_name),
        c as (select author_name, avg(upvotes) as au, max(upvotes) as hi from {d.comments} group by author_name),
        k as (select author_name, coalesce(sum(upvotes), 0) as karma from {d.activity} group by author_name),
        r as (select q.author_name, count(*) as got from {d.comments} x join {d.posts} q on q.id = x.post_id group by q.author_name)
        select a.author_name, coalesce(least(p.au / 50, 1.0), 0) as d0, coalesce(least(p.ac / 20, 1.0), 0) as d1, coalesce(least(p.hi / 100.0, 1.0), 0) as d2, coalesce((p.hi - p.lo) * 1.0 / greatest(p.hi, 1), 0) as d3,
        case when p.au > 0 then least(p.ac / nullif(p.au, 0), 1.0) else 0 end as d4, coalesce(least(c.au / 20, 1.0), 0) as d5, coalesce(least(c.hi / 50.0, 1.0), 0) as d6,
        case when p.n > 1 then least(p.n * 1.0 / p.days, 1.0) else 0 end as d7, least(k.karma / 1000.0, 1.0) as d8, least(coalesce(r.got, 0) * 1.0 / coalesce(p.n, 1) / 10, 1.0) as d9
        from a left join p on p.author_name = a.author_name left join c on c.author_name = a.author_name left join k on k.author_name = a.author_name left join r on r.author_name = a.author_name"""


def fp_engagement(d: Dialect) -> str:
    return long_of([f"d{i}" for i in range(10)], engagement_wide(d), d)


COMPONENTS = {"temporal": fp_temporal, "vocabulary": fp_vocab, "interaction": fp_interaction, "style": fp_style, "engagement": fp_engagement}
_IDS = {"temporal": "fp_temporal", "vocabulary": "fp_vocab", "interaction": "fp_interaction", "style": "fp_style", "engagement": "fp_engagement"}


def _register(component: str) -> None:
    plan = COMPONENTS[component]

    @operator(_IDS[component])
    def one(d: Dialect) -> str:
        return f"select author_name, dim, round(v, 4) as v from ({plan(d)}) f where v <> 0"


for _name in COMPONENTS:
    _register(_name)


def whole(d: Dialect, least: int = 1) -> str:
    """Every author's fingerprint in long form: author_name, part, dim (from 0 to 322), v.

    The topic part is that of a topic matrix; where none is given its dimensions are zero.
    """
    parts = " union all ".join(f"select author_name, '{name}' as part, dim + {OFFSETS[name]} as dim, v from ({plan(d)}) {name[0]}_ where v <> 0" for name, plan in COMPONENTS.items())
    keep = "" if least <= 1 else f" where author_name in (select author_name from {d.activity} group by author_name having count(*) >= {d.lit(least)})"
    return f"select * from ({parts}) f{keep}"


@operator("fp_compute")
def fp_compute(d: Dialect) -> str:
    return f"select author_name, dim, round(v, 4) as v from ({whole(d)}) f"


@operator("fp_all")
def fp_all(d: Dialect, min_activity: int = 3) -> str:
    return f"select author_name, count(*) as filled, round(sum(v), 3) as total, round(sqrt(sum(v * v)), 4) as norm from ({whole(d, min_activity)}) f group by author_name"


def pairs(d: Dialect, condition: str = "a.author_name < b.author_name") -> str:
    """Cosines of all pairs of fingerprints: whole, temporal, vocabulary, interaction, style, engagement."""
    parts = [("overall", None), ("temporal", "temporal"), ("vocabulary", "vocabulary"), ("interaction", "interaction"), ("style", "style"), ("engagement", "engagement")]
    one = lambda p: "true" if p is None else f"part = '{p}'"
    norms = ", ".join(f"sqrt(sum(case when {one(p)} then v * v else 0 end)) as n_{k}" for k, p in parts)
    dots = ", ".join(f"sum(case when {one(p).replace('part', 'a.part')} then a.v * b.v else 0 end) as d_{k}" for k, p in parts)
    cosines = ", ".join(f"coalesce(d_{k} / nullif(x.n_{k} * y.n_{k}, 0), 0) as {k}" for k, _ in parts)
    return f"""fp as ({whole(d)}), norm as (select author_name, {norms} from fp group by author_name),
        dot as (select a.author_name as author1, b.author_name as author2, {dots} from fp a join fp b on a.dim = b.dim and {condition} group by a.author_name, b.author_name),
        sim as (select author1, author2, {cosines} from dot join norm x on x.author_name = author1 join norm y on y.author_name = author2)"""


@operator("fp_similarity")
def similarity(d: Dialect, similar_pairs: str | None = None) -> str:
    """``similar_pairs`` names a relation (author1, author2, overall) of all pairs, where it is computed already."""
    sim = f"sim as (select * from {similar_pairs})" if similar_pairs else pairs(d)
    return f"with {sim} select author1, author2, round(overall, 4) as similarity from sim"


@operator("fp_compare", author1="u1", author2="u2")
def compare(d: Dialect, author1: str = "", author2: str = "") -> str:
    return f"""with {pairs(d, f"a.author_name = {d.lit(author1)} and b.author_name = {d.lit(author2)}")} select author1, author2, round(overall, 4) as overall, round(temporal, 4) as temporal, round(vocabulary, 4) as vocabulary,
        round(interaction, 4) as interaction, round(style, 4) as style, round(engagement, 4) as engagement, overall > 0.85 and temporal > 0.8 as likely_same from sim"""


@operator("fp_similar", author="u1")
def similar(d: Dialect, author: str = "", k: int = 10) -> str:
    return f"with {pairs(d, f'a.author_name = {d.lit(author)} and b.author_name <> {d.lit(author)}')} select author2 as author, round(overall, 4) as similarity from sim order by overall desc, author2 limit {int(k)}"


@operator("fp_change", threshold=0.05)
def change(d: Dialect, threshold: float = 0.5) -> str:
    """Change between the temporal fingerprints of an author's consecutive active weeks, from Monday on, over any number of years."""
    from .relational import hour_of_week

    day = f"date_trunc('week', created_at)"
    return f"""with h as (select author_name, {day} as week, {hour_of_week(d)} % 24 as k, count(*) * 1.0 as v from {d.activity} where author_name is not null group by 1, 2, 3),
        w as (select author_name, week, lag(week) over (partition by author_name order by week) as before from (select distinct author_name, week from h) x),
        n as (select author_name, week, sqrt(sum(v * v)) as norm from h group by author_name, week),
        dt as (select w.author_name, w.week, sum(a.v * b.v) as s from w join h a on a.author_name = w.author_name and a.week = w.week join h b on b.author_name = w.author_name and b.week = w.before and b.k = a.k group by w.author_name, w.week)
        select author_name, week, round(delta, 4) as delta from (select w.author_name, w.week, 1 - coalesce(dt.s, 0) / (x.norm * y.norm) as delta from w join n x on x.author_name = w.author_name and x.week = w.week
        join n y on y.author_name = w.author_name and y.week = w.before left join dt on dt.author_name = w.author_name and dt.week = w.week) z where delta > {d.lit(threshold)}"""
