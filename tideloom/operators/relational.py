"""Filters, projections, scalar functions, joins, windows, sorts and set operations as small plans."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator

# Titles that mark a post as junk, and words that mark a post as about working together.
JUNK_TITLES = ["test", "hi", "hello", "asdf", ".", "lol"]
TOGETHER = ["coordination", "collaboration", "multi-agent", "consensus", "cooperat", "governance", "protocol", "incentive"]


# ---- sources -------------------------------------------------------------------------------------------------


@operator("src_table_scan")
def table_scan(d: Dialect) -> str:
    return f"select id, author_name, submolt, upvotes, comment_count, created_at from {d.posts}"


@operator("src_html_extract")
def html_extract(d: Dialect) -> str:
    """Links and script sources of pages."""
    return f"""select page_id, 'link' as kind, {d.explode(d.matches("html", '<a[^>]*? href="([^"]*)"', 1))} as value from {d.pages}
        union all select page_id, 'script' as kind, {d.explode(d.matches("html", '<script[^>]*? src="([^"]*)"', 1))} as value from {d.pages}"""


@operator("src_api_patterns")
def api_patterns(d: Dialect) -> str:
    """Distinct matches of six patterns of interface addresses in pages and their scripts."""
    q, n = r'["\x27]', r'[^"\x27]+'
    # The patterns and the group of each that is the match.
    patterns = [
        ("/api/[a-zA-Z0-9/_-]+", 0),
        (rf'https?://[^"\x27\s]+/api/[^"\x27\s]+', 0),
        (rf"fetch\({q}({n}){q}", 1),
        (rf"axios\.[a-z]+\({q}({n}){q}", 1),
        (r'"endpoint":\s*"([^"]+)"', 1),
        (rf"baseURL{q}?\s*[:=]\s*{q}({n}){q}", 1),
    ]
    parts = [f"select page_id, {d.explode(d.matches('text', p, g))} as found from src" for p, g in patterns]
    source = f"select page_id, html || ' fetch(\"/api/items/' || cast(page_id as {d.string}) || '\") \"endpoint\": \"/v1/list\"' as text from {d.pages}"
    return f"with src as ({source}) select distinct page_id, found from ({' union all '.join(parts)}) u"


@operator("src_comments_json")
def comments_json(d: Dialect) -> str:
    """Comments that lie in a map from post to list: the key becomes the post."""
    if d.name == "spark":
        return f"""with doc as (select to_json(map(cast(post_id as string), collect_list(named_struct('id', id, 'author', author_name)))) as j from {d.comments} group by post_id),
            maps as (select explode(from_json(j, 'map<string,array<struct<id:bigint,author:string>>>')) as (key, list) from doc)
            select cast(key as bigint) as post_id, c.id as id, c.author as author_name from (select key, explode(list) as c from maps) x"""
    return f"select post_id, id, author_name from {d.comments}"


@operator("src_objectstore_merge")
def objectstore_merge(d: Dialect) -> str:
    return f"select id, author_name, created_at from {d.posts} union all select id, author_name, created_at from {d.comments}"


# ---- sinks as relations --------------------------------------------------------------------------------------


@operator("snk_upsert")
def upsert(d: Dialect) -> str:
    """New rows replace old ones of the same key: the latest wins."""
    both = f"select id, upvotes, 0 as version from {d.posts} union all select id, upvotes + 1000 as upvotes, 1 as version from {d.posts} where id % 3 = 0"
    return f"select id, upvotes, version from (select *, row_number() over (partition by id order by version desc) as r from ({both}) b) x where r = 1"


@operator("snk_append")
def append(d: Dialect) -> str:
    return f"select author_name, 1 as batch from {d.posts} where id % 2 = 0 union all select author_name, 2 as batch from {d.posts} where id % 2 = 1"


@operator("snk_update")
def update(d: Dialect) -> str:
    """Rows found on the other side take its value."""
    return f"select p.id, case when e.content_id is not null then true else false end as has_embedding from {d.posts} p left join {d.embs} e on p.id = e.content_id"


@operator("snk_json_append_dedup")
def append_dedup(d: Dialect) -> str:
    return f"""select id, 'old' as part from {d.posts} where rn % 2 = 0
        union all select n.id, 'new' as part from {d.posts} n where not exists (select 1 from {d.posts} o where o.rn % 2 = 0 and o.id = n.id)"""


@operator("snk_matrix_cache")
def matrix_info(d: Dialect) -> str:
    """Size of a stored sparse matrix: rows, columns and entries."""
    return f"select 'interaction' as matrix, count(*) as nnz, count(distinct src) as n_rows, count(distinct dst) as n_cols, sum(w) as total from {d.edges}"


# ---- filters and projections ---------------------------------------------------------------------------------


@operator("prj_nested_flatten")
def nested_flatten(d: Dialect) -> str:
    if d.name == "spark":
        nested = f"select id, named_struct('name', author_name, 'id', concat('a', author_name)) as author, if(rn % 4 = 0, null, named_struct('name', submolt)) as submolt from {d.posts}"
        return f"select id, coalesce(author.name, 'unknown') as author_name, author.id as author_id, submolt.name as submolt from ({nested}) n"
    return f"select id, author_name, concat('a', author_name) as author_id, case when rn % 4 = 0 then null else submolt end as submolt from {d.posts}"


@operator("flt_eq_param", author="u5")
def eq_param(d: Dialect, author: str = "") -> str:
    return f"select id, title, upvotes from {d.posts} where author_name = {d.lit(author)}"


@operator("flt_range")
def at_least(d: Dialect, least: int = 50) -> str:
    return f"select id, upvotes from {d.posts} where upvotes >= {d.lit(least)}"


@operator("flt_between_ts")
def between_ts(d: Dialect, late: float = 24, early: float = 72) -> str:
    return f"select id, created_at from {d.posts} where created_at > {d.ago(early)} and created_at <= {d.ago(late)}"


@operator("flt_dynamic_and", severity="high", alert_type="sockpuppet")
def dynamic_and(d: Dialect, severity: str | None = None, alert_type: str | None = None, status: str | None = "active") -> str:
    """Only the predicates that are given apply."""
    wanted = {"severity": severity, "alert_type": alert_type, "status": status}
    where = " and ".join(f"{k} = {d.lit(v)}" for k, v in wanted.items() if v is not None) or "true"
    return f"select id, alert_type, severity, status from {d.alerts} where {where}"


@operator("flt_in_list", authors=["u1", "u2", "u3"])
def in_list(d: Dialect, authors: list[str] | None = None) -> str:
    return f"select id, author_name from {d.posts} where author_name in ({', '.join(d.lit(a) for a in authors or [''])})"


@operator("flt_in_literals", titles=["the", "And"])
def in_literals(d: Dialect, titles: list[str] | None = None) -> str:
    return f"select id, title from {d.posts} where substr(title, 1, 3) in ({', '.join(d.lit(t) for t in titles or JUNK_TITLES)})"


@operator("flt_not_null")
def not_null(d: Dialect) -> str:
    return f"select id from {d.posts} where content is not null"


@operator("flt_ne", author="u5")
def not_equal(d: Dialect, author: str = "") -> str:
    return f"select id, author_name from {d.posts} where author_name <> {d.lit(author)}"


@operator("flt_like_ci", words=["the", "with"])
def like_ci(d: Dialect, words: list[str] | None = None) -> str:
    """Posts that name one of the words, whatever the case, best first."""
    use = words or TOGETHER
    return f"select id, title, author_name, upvotes, comment_count from {d.posts} where {d.any_of('title', use)} or {d.any_of('content', use)} order by upvotes desc, comment_count desc, id limit 30"


@operator("flt_lower_like", word="with")
def lower_like(d: Dialect, word: str = "trust") -> str:
    return f"select id from {d.posts} where lower(title) like {d.lit('%' + word + '%')} or lower(content) like {d.lit('%' + word + '%')}"


@operator("flt_json_membership", author="u7")
def membership(d: Dialect, author: str = "") -> str:
    return f"select id, alert_type from {d.alerts} where {d.contains('involved_authors', d.lit(author))}"


@operator("prj_case")
def case_topics(d: Dialect) -> str:
    return f"""select id, case when title ilike '%the%' then 'the' when title ilike '%und%' then 'und' when content ilike '%que%' then 'que' else 'other' end as topic from {d.posts}"""


@operator("sc_substr")
def cut_text(d: Dialect, n: int = 500) -> str:
    return f"select id, substr(content, 1, {d.lit(n)}) as part from {d.posts} where content is not null"


@operator("sc_length")
def text_length(d: Dialect) -> str:
    return f"select id, length(content) as n, length(content) < 50 as short from {d.posts} where content is not null"


@operator("sc_concat")
def joined_text(d: Dialect) -> str:
    return f"select id, trim(coalesce(title, '') || ' ' || coalesce(content, '')) as text from {d.posts}"


@operator("sc_md5")
def content_md5(d: Dialect) -> str:
    return f"select id, md5(lower({d.replace_all('content', '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '')})) as content_hash from {d.posts} where content is not null"


@operator("sc_ws_normalise")
def normalised(d: Dialect) -> str:
    inner = d.replace_all("content", "^\\s+|\\s+$", "")
    return f"select id, substr({d.join_array(d.split_space('lower(' + inner + ')'), ' ')}, 1, 200) as key from {d.posts} where content is not null"


@operator("sc_regex_tokens")
def tokens(d: Dialect, least: int = 4, most: int = 15) -> str:
    return f"select word, count(*) as n from (select {d.explode(d.tokens('content', least, most))} as word from {d.posts}) t group by word"


@operator("sc_regex_count")
def regex_counts(d: Dialect) -> str:
    return f"""select id, {d.count_matches('content', 'https?://')} as urls, {d.count_matches('content', '[0-9]+')} as numbers,
        {d.count_matches('content', '(?m)^[-*0-9.][ \\t]')} as lists from {d.posts} where content is not null"""


@operator("sc_char_count")
def char_counts(d: Dialect) -> str:
    marks = {"dots": "[.]", "commas": "[,]", "questions": "[?]", "shouts": "[!]", "newlines": "\\n", "capitals": "[A-Z]"}
    return f"select id, {', '.join(f'{d.count_matches("content", p)} as {k}' for k, p in marks.items())} from {d.posts} where content is not null"


@operator("sc_arith_guard")
def guarded(d: Dialect) -> str:
    return f"select id, round(upvotes * 1.0 / nullif(comment_count, 0), 4) as ratio, least(upvotes / 100.0, 1.0) as capped, greatest(comment_count, 1) as at_least_one from {d.posts}"


@operator("sc_coalesce")
def filled(d: Dialect) -> str:
    return f"select id, coalesce(nullif(content, ''), title, 'none') is null as gone, coalesce(length(content), 0) as n from {d.posts}"


@operator("sc_round")
def rounded(d: Dialect) -> str:
    return f"select author_name, round(avg(upvotes), 1) as r1, round(avg(upvotes), 3) as r3 from {d.posts} group by author_name"


@operator("sc_log")
def logs(d: Dialect) -> str:
    return f"select id, round(ln(comment_count + 1), 6) as v from {d.posts}"


@operator("dt_now_minus")
def within(d: Dialect, hours: float = 48) -> str:
    return f"select id, created_at from {d.posts} where created_at > {d.ago(hours)}"


@operator("dt_julian_diff")
def age_days(d: Dialect) -> str:
    return f"select id, round({d.days(d.now, 'created_at')}, 6) as age from {d.posts}"


@operator("dt_year_week")
def year_week(d: Dialect) -> str:
    """Year and week, weeks beginning on Monday, days before the first Monday in week 00."""
    week = d.idiv(f"(extract(doy from created_at) + 6 - {d.weekday('created_at')})", "7")
    return f"select id, concat(cast(extract(year from created_at) as {d.string}), '-', lpad(cast({week} as {d.string}), 2, '0')) as week from {d.posts}"


def hour_of_week(d: Dialect, ts: str = "created_at") -> str:
    return f"({d.weekday(ts)} * 24 + extract(hour from {ts}))"


@operator("dt_hour_of_week")
def how(d: Dialect) -> str:
    return f"select id, {hour_of_week(d)} as how from {d.posts}"


@operator("dt_hour_bucket")
def hour_bucket(d: Dialect) -> str:
    return f"select date_trunc('hour', created_at) as hour, count(*) as n from {d.activity} group by 1"


def hour_offset(d: Dialect, days: float, ts: str = "created_at") -> str:
    """Whole hours since ``days`` before now; for rows after that time only."""
    return f"cast(floor(({d.micros(ts)} - {d.micros(d.ago(24 * days))}) / 3.6e9) as int)"


@operator("dt_hour_offset")
def offsets(d: Dialect, days: float = 7) -> str:
    return f"select id, {hour_offset(d, days)} as h from {d.posts} where created_at >= {d.ago(24 * days)}"


@operator("dt_days_between")
def days_between(d: Dialect) -> str:
    return f"select author_name, cast(floor({d.days('max(created_at)', 'min(created_at)')}) as bigint) + 1 as days from {d.posts} group by author_name"


@operator("js_dump_load")
def json_round_trip(d: Dialect) -> str:
    if d.name == "spark":
        return f"select id, v.a as author, v.n as n from (select id, from_json(to_json(named_struct('a', author_name, 'n', upvotes)), 'a string, n bigint') as v from {d.posts}) x"
    return f"select id, author_name as author, upvotes as n from {d.posts}"


@operator("ar_set_ops")
def set_sizes(d: Dialect) -> str:
    a, b = "a.involved_authors", "b.involved_authors"
    return f"""select a.id as id1, b.id as id2, {d.overlap(a, b)} as both, {d.all_of(a, b)} as either from {d.alerts} a join {d.alerts} b on a.alert_type = b.alert_type and a.severity = b.severity and a.id < b.id"""


@operator("ar_slice")
def slices(d: Dialect, n: int = 2) -> str:
    return f"select id, {d.join_array(d.first_of('involved_authors', n), ',')} as first_authors from {d.alerts}"


@operator("vec_dot")
def dots(d: Dialect) -> str:
    return f"select a.content_id as id1, b.content_id as id2, round({d.dot('a.embedding', 'b.embedding')}, 5) + 0.0 as v from {d.embs} a join {d.embs} b on b.content_id > a.content_id and a.content_id % 50 = b.content_id % 50"


@operator("vec_norm")
def norms(d: Dialect) -> str:
    return f"select content_id, round(sqrt({d.dot('embedding', 'embedding')}), 5) as v from {d.embs}"


@operator("vec_cosine")
def cosines(d: Dialect) -> str:
    return f"select a.content_id as id1, b.content_id as id2, round({d.cosine('a.embedding', 'b.embedding')}, 5) + 0.0 as v from {d.embs} a join {d.embs} b on b.content_id > a.content_id and a.content_id % 40 = b.content_id % 40"


def positions(d: Dialect, relation: str, keep: str, vector: str = "embedding") -> str:
    """One row per entry of a vector: the columns ``keep``, ix (from 0) and v."""
    if d.name == "spark":
        return f"select {keep}, ix, cast(v as double) as v from {relation} lateral view posexplode({vector}) x as ix, v"
    return f"select {keep}, generate_subscripts({vector}, 1) - 1 as ix, cast(unnest({vector}) as double) as v from {relation}"


@operator("vec_mean")
def means(d: Dialect) -> str:
    rows = positions(d, f"(select p.author_name, e.embedding from {d.embs} e join {d.posts} p on p.id = e.content_id) s", "author_name")
    return f"select author_name, ix, round(avg(v), 5) + 0.0 as mean from ({rows}) r group by author_name, ix"


@operator("vec_normalise")
def normalise(d: Dialect) -> str:
    rows = positions(d, d.embs, f"content_id, sqrt({d.dot('embedding', 'embedding')}) as norm")
    return f"select content_id, ix, round(v / case when norm = 0 then 1 else norm end, 5) + 0.0 as v from ({rows}) r"


# ---- joins ---------------------------------------------------------------------------------------------------


@operator("jn_inner_reply")
def reply(d: Dialect) -> str:
    return f"select c.id as comment_id, p.id as post_id, c.author_name as commenter, p.author_name as poster from {d.comments} c join {d.posts} p on c.post_id = p.id"


@operator("jn_inner_embed")
def embedded_posts(d: Dialect) -> str:
    return f"select p.id, p.author_name, p.created_at from {d.embs} e join {d.posts} p on p.id = e.content_id where e.content_type = 'post'"


@operator("jn_left_poly")
def left_poly(d: Dialect) -> str:
    """Content of either kind, by a discriminator in the join condition."""
    return f"""select e.content_id, e.content_type, coalesce(p.author_name, c.author_name) as author_name, case when p.id is not null then 'p' when c.id is not null then 'c' end as side
        from {d.embs} e left join {d.posts} p on e.content_id = p.id and e.content_type = 'post' left join {d.comments} c on e.content_id = c.id and e.content_type = 'comment'"""


@operator("jn_left_fanout")
def left_fanout(d: Dialect) -> str:
    return f"select p.author_name, count(distinct c.id) as replies, count(distinct p.id) as posts, round(avg(p.upvotes), 4) as avg_up from {d.posts} p left join {d.comments} c on p.id = c.post_id group by p.author_name"


@operator("jn_theta_pairs", threshold=0.3)
def theta_pairs(d: Dialect, threshold: float = 0.7) -> str:
    return f"select id1, id2, round(s, 4) as similarity from (select a.content_id as id1, b.content_id as id2, {d.cosine('a.embedding', 'b.embedding')} as s from {d.embs} a join {d.embs} b on a.content_id < b.content_id) x where s >= {d.lit(threshold)}"


@operator("jn_anti_not_in")
def anti_not_in(d: Dialect) -> str:
    return f"select p.id from {d.posts} p where not exists (select 1 from {d.embs} e where e.content_id = p.id)"


@operator("jn_anti_spam")
def anti_spam(d: Dialect, most: float = 50) -> str:
    return f"select p.id from {d.posts} p where not exists (select 1 from {d.spam_scores} s where s.content_id = p.id and s.spam_score >= {d.lit(most)})"


@operator("jn_anti_pairs")
def anti_pairs(d: Dialect) -> str:
    """Pairs of authors that never replied to each other."""
    return f"""with a as (select distinct author_name from {d.activity}), met as (select src, dst from {d.edges} union select dst, src from {d.edges})
        select a.author_name as author1, b.author_name as author2 from a a join a b on a.author_name < b.author_name
        where not exists (select 1 from met where met.src = a.author_name and met.dst = b.author_name)"""


@operator("jn_semi_filter")
def semi_filter(d: Dialect, least: int = 5) -> str:
    return f"select p.id, p.author_name from {d.posts} p where p.author_name in (select author_name from {d.activity} group by author_name having count(*) >= {d.lit(least)})"


@operator("jn_period_compare", hours=48)
def period_compare(d: Dialect, hours: float = 6) -> str:
    return f"""with now_ as (select author_name, count(*) as n, avg(upvotes) as a from {d.posts} where created_at > {d.ago(hours)} group by author_name),
        before_ as (select author_name, avg(upvotes) as a from {d.posts} where created_at > {d.ago(2 * hours)} and created_at <= {d.ago(hours)} group by author_name)
        select n.author_name, n.n, round(n.a, 4) as now_avg, round(b.a, 4) as before_avg from now_ n join before_ b on n.author_name = b.author_name"""


@operator("jn_range_time_sym", as_of="2024-01-05 00:00:00", threshold=0.1)
def range_sym(d: Dialect, minutes: int = 30, threshold: float = 0.7, near_pairs: str | None = None) -> str:
    """Similar posts within the window: an equi-join on neighbouring time buckets, then the exact test.

    ``near_pairs`` names a relation (x, y, s) of these pairs, where it is computed already.
    """
    if near_pairs:
        return f"select x as id1, y as id2, round(s, 4) as similarity from {near_pairs}"
    span = int(minutes * 60_000_000)
    bucket = d.idiv(d.micros("p.created_at"), str(span))
    return f"""with e as (select p.id, p.created_at, v.embedding, {bucket} as b from {d.embs} v join {d.posts} p on p.id = v.content_id),
        near as (select *, {d.explode(d.array('b - 1', 'b', 'b + 1'))} as nb from e)
        select a.id as id1, b.id as id2, round({d.cosine('a.embedding', 'b.embedding')}, 4) as similarity from e a join near b on a.b = b.nb and a.id < b.id
        where abs({d.micros('a.created_at')} - {d.micros('b.created_at')}) <= {span} and {d.cosine('a.embedding', 'b.embedding')} >= {d.lit(threshold)}"""


@operator("jn_range_time_fwd", hours=96)
def range_fwd(d: Dialect, hours: float = 2) -> str:
    span = int(hours * 3_600_000_000)
    return f"""with n as (select n.narrative_id, n.post_id, {d.micros('n.created_at')} as t, {d.idiv(d.micros('n.created_at'), str(span))} as b from {d.narrative_posts} n),
        near as (select *, {d.explode(d.array('b - 1', 'b'))} as nb from n)
        select a.narrative_id, a.post_id as post1, b.post_id as post2 from n a join near b on a.narrative_id = b.narrative_id and a.b = b.nb
        where b.t >= a.t and b.t - a.t <= {span} and a.post_id <> b.post_id"""


@operator("jn_author_pairs")
def author_pairs(d: Dialect) -> str:
    return f"with a as (select author_name, count(*) as n from {d.activity} group by author_name) select a.author_name as author1, b.author_name as author2, a.n + b.n as n from a a join a b on a.author_name < b.author_name"


@operator("jn_common_authors")
def common_authors(d: Dialect) -> str:
    return f"select a.author_name from (select distinct src as author_name from {d.edges}) a join (select distinct dst as author_name from {d.edges}) b on a.author_name = b.author_name join (select distinct author_name from {d.posts}) c on a.author_name = c.author_name"


@operator("jn_matmul")
def matmul(d: Dialect) -> str:
    """A times its transpose in long form."""
    return f"select a.src as r1, b.src as r2, sum(a.w * b.w) as v from {d.edges} a join {d.edges} b on a.dst = b.dst group by a.src, b.src"


@operator("jn_lookup_row")
def lookup_row(d: Dialect) -> str:
    return f"select p.id, p.title, a.n as author_posts from {d.posts} p join (select author_name, count(*) as n from {d.posts} group by author_name) a on a.author_name = p.author_name"


# ---- windows -------------------------------------------------------------------------------------------------


@operator("wn_dedup_best")
def dedup_best(d: Dialect) -> str:
    return f"select id, upvotes from (select id, upvotes, row_number() over (partition by substr(lower(content), 1, 200) order by upvotes desc, id) as r from {d.posts} where content is not null) x where r = 1"


def narrative_gaps(d: Dialect) -> str:
    """Posts of narratives with their authors and the minutes since the author's last one in the narrative."""
    return f"""select n.narrative_id, n.post_id, p.author_name, n.created_at,
        ({d.micros('n.created_at')} - lag({d.micros('n.created_at')}) over (partition by n.narrative_id, p.author_name order by n.created_at, n.post_id)) / 6.0e7 as gap
        from {d.narrative_posts} n join {d.posts} p on p.id = n.post_id"""


@operator("wn_lag_interval")
def lag_interval(d: Dialect) -> str:
    return f"select narrative_id, post_id, round(gap, 4) as gap from ({narrative_gaps(d)}) g"


@operator("wn_running_avg")
def running_avg(d: Dialect) -> str:
    return f"select narrative_id, post_id, round(avg(gap) over (partition by narrative_id, author_name order by created_at, post_id rows between unbounded preceding and current row), 4) as mean_gap from ({narrative_gaps(d)}) g"


def roles(d: Dialect, least: int = 3) -> str:
    """Role of every post in narratives of at least ``least`` posts."""
    return f"""select narrative_id, post_id, author_name, created_at, k, n,
        case when k = 1 then 'originator' when k <= greatest(1, cast(floor(n * 0.1) as bigint)) then 'early_adopter' when own >= 2 and mean_gap < 30 then 'amplifier' else 'organic' end as role
        from (select *, row_number() over (partition by narrative_id order by created_at, post_id) as k, count(*) over (partition by narrative_id) as n,
            row_number() over (partition by narrative_id, author_name order by created_at, post_id) as own,
            avg(gap) over (partition by narrative_id, author_name order by created_at, post_id rows between unbounded preceding and current row) as mean_gap
            from ({narrative_gaps(d)}) g) x where n >= {d.lit(least)}"""


@operator("wn_role_rank")
def role_rank(d: Dialect) -> str:
    return f"select narrative_id, post_id, k, role from ({roles(d)}) r"


@operator("wn_islands")
def islands(d: Dialect, least: int = 8) -> str:
    """Runs of consecutive busy hours."""
    return f"""with h as (select extract(doy from created_at) * 24 + extract(hour from created_at) as h, count(*) as n from {d.activity} group by 1 having count(*) >= {d.lit(least)})
        select min(h) as first_hour, max(h) as last_hour, sum(n) as n from (select h, n, h - row_number() over (order by h) as g from h) x group by g"""


@operator("wn_prev_vector")
def prev_vector(d: Dialect) -> str:
    """Change of an author's vector from one post to the next."""
    return f"""select id, author_name, round(1 - {d.cosine('embedding', 'before')}, 4) + 0.0 as delta from (
        select p.id, p.author_name, e.embedding, lag(e.embedding) over (partition by p.author_name order by p.created_at, p.id) as before from {d.embs} e join {d.posts} p on p.id = e.content_id) x where before is not null"""


@operator("wn_comment_gaps")
def comment_gaps(d: Dialect) -> str:
    return f"""select post_id, count(*) as n, round(avg(gap), 3) as mean_gap, round(stddev_pop(gap), 3) as std_gap from (
        select post_id, ({d.micros('created_at')} - lag({d.micros('created_at')}) over (partition by post_id order by created_at, id)) / 1.0e6 as gap from {d.comments}) x where gap is not null group by post_id"""


@operator("wn_forward_range")
def forward_range(d: Dialect, hours: float = 2) -> str:
    """Authors in the two hours after each post of a narrative."""
    span = int(hours * 3600)
    sec = d.idiv(d.micros("n.created_at"), "1000000")
    return f"""with n as (select n.narrative_id, n.post_id, p.author_name, {sec} as t from {d.narrative_posts} n join {d.posts} p on p.id = n.post_id)
        select a.narrative_id, a.post_id, count(distinct b.author_name) as authors, count(*) as posts from n a join n b on a.narrative_id = b.narrative_id and b.t between a.t and a.t + {span} group by a.narrative_id, a.post_id"""


@operator("wn_argmax")
def argmax(d: Dialect) -> str:
    return f"select author_name, hour from (select author_name, extract(hour from created_at) as hour, row_number() over (partition by author_name order by count(*) desc, extract(hour from created_at)) as r from {d.activity} group by author_name, extract(hour from created_at)) x where r = 1"


# ---- sorts and sets ------------------------------------------------------------------------------------------


@operator("so_topk")
def topk(d: Dialect, k: int = 10) -> str:
    return f"select id, upvotes from {d.posts} order by upvotes desc, id limit {int(k)}"


@operator("so_multi")
def multi(d: Dialect, k: int = 20) -> str:
    return f"select id, upvotes, comment_count from {d.posts} order by upvotes desc, comment_count desc, id limit {int(k)}"


@operator("so_abs")
def by_abs(d: Dialect, k: int = 20) -> str:
    return f"select id, upvotes - 50 as v from {d.posts} order by abs(upvotes - 50) desc, id limit {int(k)}"


@operator("so_nulls")
def nulls(d: Dialect, k: int = 50) -> str:
    return f"select id, round(upvotes * 1.0 / nullif(comment_count, 0), 4) as ratio from {d.posts} order by upvotes * 1.0 / nullif(comment_count, 0) desc nulls last, id limit {int(k)}"


@operator("so_time")
def by_time(d: Dialect, k: int = 50) -> str:
    return f"select id, created_at from {d.posts} order by created_at, id limit {int(k)}"


@operator("st_union_all")
def union_all(d: Dialect) -> str:
    return f"select author_name, created_at, kind from {d.activity}"


@operator("st_distinct")
def distinct(d: Dialect) -> str:
    return f"select distinct c.author_name as src, p.author_name as dst from {d.comments} c join {d.posts} p on p.id = c.post_id"


@operator("st_intersect")
def intersect(d: Dialect) -> str:
    return f"select author_name from {d.posts} intersect select author_name from {d.comments}"


@operator("st_union_distinct")
def union_distinct(d: Dialect) -> str:
    return f"select src as author, dst as other from {d.edges} union select dst as author, src as other from {d.edges}"


@operator("st_difference")
def difference(d: Dialect) -> str:
    return f"select id from {d.posts} except select content_id as id from {d.embs}"
