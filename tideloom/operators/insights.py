"""Engagement insights: boards, trends, duplicates, spam, influence and topics."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..plans.registry import operator
from .relational import JUNK_TITLES

# Topics and the words that show them, in order of precedence.
GAP_TOPICS = [("trust", "trust"), ("coordination", "coordination"), ("infrastructure", "infrastructure"), ("games", "game"), ("mcp", "MCP"), ("security", "security")]
HOT_TOPICS = [("karma_farming", "karma"), ("infrastructure", "infrastructure"), ("trust", "trust"), ("coordination", "coordinat")]
TITLE_TOPICS = [("trust", "trust"), ("coordination", "coordination"), ("agent", "agent"), ("MCP", "mcp"), ("security", "security")]
GRAPH_TOPICS = ["trust", "coordination", "infrastructure", "security", "game", "MCP", "agent", "protocol", "network", "consensus", "governance", "API", "model", "tool", "code", "memory", "context", "prompt"]
# Topics that the test tables' language has.
TEST_TOPICS = [("the", "the"), ("und", " und "), ("que", " que "), ("ing", "ing")]


def topic_case(d: Dialect, topics: list, columns: tuple[str, ...] = ("title", "content")) -> str:
    whens = " ".join(f"when {' or '.join(f'{c} ilike {d.lit("%" + word + "%")}' for c in columns)} then {d.lit(name)}" for name, word in topics)
    return f"case {whens} else 'other' end"


@operator("ag_stats")
def stats(d: Dialect) -> str:
    return f"""select (select count(*) from {d.posts}) as posts, (select count(*) from {d.comments}) as comments, (select count(*) from {d.embs}) as embeddings,
        (select count(distinct author_name) from {d.activity}) as agents, (select coalesce(sum(upvotes), 0) from {d.posts}) as total_upvotes"""


@operator("ag_agents_board")
def agents_board(d: Dialect, min_posts: int = 3, min_avg_upvotes: float = 2.0) -> str:
    return f"""select author_name, count(*) as post_count, round(avg(upvotes), 2) as avg_upvotes, sum(upvotes) as total_upvotes from {d.posts} where author_name is not null
        group by author_name having count(*) >= {d.lit(min_posts)} and avg(upvotes) >= {d.lit(min_avg_upvotes)}"""


@operator("ag_agents_build")
def agents_build(d: Dialect) -> str:
    return f"""select p.author_name as name, p.post_count, coalesce(c.n, 0) as comment_count, p.avg_upvotes, p.first_seen, p.last_active from
        (select author_name, count(*) as post_count, round(avg(upvotes), 4) as avg_upvotes, min(created_at) as first_seen, max(created_at) as last_active from {d.posts} where author_name is not null group by author_name) p
        left join (select author_name, count(*) as n from {d.comments} group by author_name) c on c.author_name = p.author_name"""


@operator("ag_high_signal")
def high_signal(d: Dialect, min_posts: int = 3, min_avg_upvotes: float = 2.0, k: int = 50) -> str:
    return f"""select author_name, n, round(a, 4) as avg_upvotes, total from (select author_name, count(*) as n, avg(upvotes) as a, sum(upvotes) as total from {d.posts} group by author_name) x
        where n >= {d.lit(min_posts)} and a >= {d.lit(min_avg_upvotes)} order by a desc, total desc, author_name limit {int(k)}"""


@operator("ag_agent_profile", author="u5")
def agent_profile(d: Dialect, author: str | None = None, k: int = 10) -> str:
    """Six views of an author (or of every author) as rows: section, key, value."""
    own = "" if author is None else f" and author_name = {d.lit(author)}"
    s = d.string
    week = f"concat(cast(extract(year from created_at) as {s}), '-', lpad(cast({d.idiv(f'(extract(doy from created_at) + 6 - {d.weekday("created_at")})', '7')} as {s}), 2, '0'))"
    return f"""with p as (select * from {d.posts} where author_name is not null{own}), c as (select * from {d.comments} where author_name is not null{own}),
        talk as (select c.author_name, q.author_name as other, count(*) as n from c join {d.posts} q on q.id = c.post_id where q.author_name <> c.author_name group by c.author_name, q.author_name)
        select author_name, 'posts' as section, 'count' as key, cast(count(*) as double) as value from p group by author_name
        union all select author_name, 'posts', 'avg_upvotes', round(avg(upvotes), 2) from p group by author_name
        union all select author_name, 'posts', 'max_upvotes', cast(max(upvotes) as double) from p group by author_name
        union all select author_name, 'comments', 'count', cast(count(*) as double) from c group by author_name
        union all select author_name, 'top_posts', cast(id as {s}), cast(upvotes as double) from (select author_name, id, upvotes, row_number() over (partition by author_name order by upvotes desc, id) as r from p) x where r <= {int(k)}
        union all select author_name, 'weeks', {week}, cast(count(*) as double) from p where created_at > {d.ago(28 * 24)} group by author_name, {week}
        union all select author_name, 'communities', submolt, cast(n as double) from (select author_name, submolt, count(*) as n, row_number() over (partition by author_name order by count(*) desc, submolt) as r from p where submolt is not null group by author_name, submolt) x where r <= {int(k)}
        union all select author_name, 'talks_with', other, cast(n as double) from (select author_name, other, n, row_number() over (partition by author_name order by n desc, other) as r from talk) x where r <= {int(k)}"""


@operator("ag_trending", hours=48)
def trending(d: Dialect, hours: float = 6, growth: float = 50, k: int = 20) -> str:
    """Authors whose mean upvotes grew from the period before to this one, in one pass over the posts."""
    now, before = f"created_at > {d.ago(hours)}", f"created_at > {d.ago(2 * hours)} and created_at <= {d.ago(hours)}"
    return f"""select author_name, recent_posts, round(a, 1) as avg_upvotes, round((a - b) / b * 100, 1) as growth_percent, total from (
        select author_name, count(case when {now} then 1 end) as recent_posts, avg(case when {now} then upvotes end) as a, avg(case when {before} then upvotes end) as b, sum(case when {now} then upvotes end) as total
        from {d.posts} where author_name is not null and created_at > {d.ago(2 * hours)} group by author_name) x
        where recent_posts >= 2 and case when b > 0 then (a - b) / b * 100 > {d.lit(growth)} else false end
        order by (a - b) / nullif(b, 0) desc, author_name limit {int(k)}"""


@operator("ag_conv_clusters", hours=168)
def conv_clusters(d: Dialect, hours: float = 24, least: int = 10, k: int = 15) -> str:
    return f"""with hot as (select id, substr(title, 1, 100) as title, author_name, upvotes, comment_count from {d.posts} where created_at > {d.ago(hours)} and comment_count >= {d.lit(least)} order by comment_count desc, id limit {int(k)}),
        who as (select c.post_id, c.author_name, count(*) as n from {d.comments} c join hot on hot.id = c.post_id where c.author_name is not null group by c.post_id, c.author_name),
        ranked as (select *, row_number() over (partition by post_id order by n desc, author_name) as r, count(*) over (partition by post_id) as participants from who)
        select h.id, h.title, h.author_name, h.upvotes, h.comment_count, max(r.participants) as participant_count, {d.joined('r.author_name')} as participants
        from hot h join ranked r on r.post_id = h.id and r.r <= 10 group by h.id, h.title, h.author_name, h.upvotes, h.comment_count"""


@operator("ag_centrality_simple")
def centrality_simple(d: Dialect, hours: float = 48, k: int = 25) -> str:
    return f"""with e as (select distinct c.author_name as src, p.author_name as dst from {d.comments} c join {d.posts} p on p.id = c.post_id
            where c.author_name is not null and p.author_name is not null and c.author_name <> p.author_name and c.created_at > {d.ago(hours)}),
        o as (select src as a, count(*) as reaches from e group by src), i as (select dst as a, count(*) as engaged_by from e group by dst),
        t as (select a, count(*) as total from (select src as a, dst as b from e union select dst, src from e) u group by a)
        select o.a as agent, o.reaches, coalesce(i.engaged_by, 0) as engaged_by, t.total as total_connections, o.reaches as interaction_count
        from o join t on t.a = o.a left join i on i.a = o.a order by total_connections desc, agent limit {int(k)}"""


@operator("ag_viral")
def viral(d: Dialect, hours: float = 6, k: int = 10) -> str:
    return f"""select id, substr(title, 1, 80) as title, author_name, upvotes, round(v, 2) as velocity from (select *, upvotes / ({d.days(d.now, 'created_at')} + 0.001) as v from {d.posts} where created_at > {d.ago(hours)} and upvotes > 10) x order by v desc, id limit {int(k)}"""


@operator("ag_activity_spike", hours=96)
def activity_spike(d: Dialect, hours: float = 6, least: int = 5, k: int = 15) -> str:
    return f"select author_name, count(*) as posts from {d.posts} where created_at > {d.ago(hours)} and author_name is not null group by author_name having count(*) >= {d.lit(least)} order by posts desc, author_name limit {int(k)}"


@operator("ag_content_gaps", as_of="2024-01-05 00:00:00", topics=TEST_TOPICS, most=100000)
def content_gaps(d: Dialect, hours: float = 24, topics: list | None = None, most: int = 10) -> str:
    return f"""select topic, n as post_count, round(a, 1) as avg_upvotes, round(c, 1) as avg_comments, round(a * c / (n + 1), 2) as opportunity_score from (
        select {topic_case(d, topics or GAP_TOPICS)} as topic, count(*) as n, avg(upvotes) as a, avg(comment_count) as c from {d.posts} where created_at > {d.ago(hours)} group by 1 having count(*) < {d.lit(most)}) x where topic <> 'other'"""


@operator("ag_hot_topics", as_of="2024-01-05 00:00:00", hours=24, topics=TEST_TOPICS)
def hot_topics(d: Dialect, hours: float = 3, topics: list | None = None, k: int = 10) -> str:
    return f"""select topic, n as recent_posts, round(a, 1) as avg_upvotes, m as max_upvotes, round(a * 0.5 + m * 0.5, 1) as viral_potential from (
        select {topic_case(d, topics or HOT_TOPICS)} as topic, count(*) as n, avg(upvotes) as a, max(upvotes) as m from {d.posts} where created_at > {d.ago(hours)} group by 1) x where topic <> 'other' order by a * 0.5 + m * 0.5 desc, topic limit {int(k)}"""


def content_hash(d: Dialect) -> str:
    return f"md5(lower({d.replace_all('content', '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '')}))"


@operator("ag_exact_dups")
def exact_dups(d: Dialect, k: int = 20) -> str:
    """Groups of equal content: the most upvoted, then earliest, post stands for the group."""
    return f"""with h as (select id, title, author_name, upvotes, created_at, {content_hash(d)} as h from {d.posts} where content is not null and content <> ''),
        r as (select *, row_number() over (partition by h order by upvotes desc, created_at, id) as r, count(*) over (partition by h) as n from h)
        select max(case when r = 1 then id end) as canonical_id, max(case when r = 1 then substr(title, 1, 80) end) as title, max(case when r = 1 then author_name end) as author, max(n) - 1 as duplicate_count,
        {d.joined('case when r > 1 then id end')} as duplicate_ids from r where n > 1 group by h order by duplicate_count desc, canonical_id limit {int(k)}"""


@operator("ag_near_dups", threshold=0.4)
def near_dups(d: Dialect, threshold: float = 0.95, k: int = 20, cosines: str | None = None) -> str:
    """Pairs of posts with very similar vectors, all pairs and not the first few thousand; ``cosines`` names a relation (x, y, s) of those that may be among the first."""
    pairs = f"""select a.content_id as x, b.content_id as y, {d.cosine('a.embedding', 'b.embedding')} as s from {d.embs} a join {d.embs} b on a.content_id < b.content_id where a.content_type = 'post' and b.content_type = 'post'"""
    source = f"select x, y, s from {cosines}" if cosines else pairs
    return f"""with s as ({source})
        select case when q.upvotes > p.upvotes then q.id else p.id end as canonical_id, case when q.upvotes > p.upvotes then p.id else q.id end as similar_id, round(s, 3) as similarity
        from s join {d.posts} p on p.id = s.x join {d.posts} q on q.id = s.y where s > {d.lit(threshold)} order by s desc, p.id, q.id limit {int(k)}"""


@operator("ag_spam", as_of="2024-01-05 00:00:00", hours=100, velocity=1)
def spam(d: Dialect, hours: float = 24, velocity: int = 10, k: int = 30) -> str:
    """Scores of low-effort posts and their reasons.  A junk title admits a post but adds nothing to its score."""
    titles = ", ".join(d.lit(t) for t in JUNK_TITLES)
    return f"""with fast as (select author_name from {d.posts} where created_at > {d.ago(1)} and author_name is not null group by author_name having count(*) > {d.lit(velocity)}),
        c as (select p.*, case when content <> '' and length(content) < 50 then 1 else 0 end as short, case when title <> '' and length(title) < 3 then 1 else 0 end as bare,
            case when f.author_name is not null then 1 else 0 end as quick, case when upvotes = 0 and comment_count = 0 then 1 else 0 end as silent
            from {d.posts} p left join fast f on f.author_name = p.author_name where created_at > {d.ago(hours)} and (length(content) < 50 or title in ({titles}) or length(title) < 3))
        select id, author_name, least(s, 100) as spam_score, reasons from (select *, 30 * short + 20 * bare + 40 * quick + 10 * silent as s,
            concat(case when short = 1 then 'short_content;' else '' end, case when bare = 1 then 'generic_title;' else '' end, case when quick = 1 then 'high_velocity;' else '' end, case when silent = 1 then 'no_engagement;' else '' end) as reasons from c) x
        where s > 0 order by s desc, id limit {int(k)}"""


@operator("ag_velocity_spam", hours=24, most=1)
def velocity_spam(d: Dialect, hours: float = 1, most: int = 10) -> str:
    return f"select author_name, count(*) as posts_per_hour from {d.posts} where created_at > {d.ago(hours)} and author_name is not null group by author_name having count(*) > {d.lit(most)}"


@operator("ag_repetitive", as_of="2024-01-31 00:00:00", hours=720)
def repetitive(d: Dialect, hours: float = 24) -> str:
    return f"select author_name, count(distinct content) as unique_content, count(*) as total from {d.posts} where created_at > {d.ago(hours)} and author_name is not null group by author_name having count(*) > 3 and count(distinct content) < {d.idiv('count(*)', '2')}"


@operator("ag_influence")
def influence(d: Dialect, hours: float = 168, k: int = 20) -> str:
    """Replies, diversity and quality; the mean of upvotes is weighted by comments, as the join makes it."""
    return f"""with x as (select p.author_name as author, count(distinct c.id) as replies, count(distinct c.author_name) as repliers, avg(p.upvotes) as a, count(distinct p.id) as posts
            from {d.posts} p left join {d.comments} c on p.id = c.post_id where p.author_name is not null and p.created_at > {d.ago(hours)} group by p.author_name having count(distinct p.id) >= 2),
        top_ as (select * from x order by replies desc, author limit 50)
        select author, replies as total_replies, repliers as unique_repliers, round(a, 1) as avg_upvotes, posts, round(s, 2) as influence_score from (
        select *, case when replies = 0 then 0.0 else replies * (repliers * 1.0 / replies) * (case when a = 0 then 1.0 else a end) / posts end as s from top_) y order by s desc, author limit {int(k)}"""


@operator("ag_reciprocity")
def reciprocity(d: Dialect, hours: float = 168, k: int = 15) -> str:
    return f"""select c.author_name as author, count(distinct c.post_id) as posts_replied_to, count(distinct p.author_name) as unique_authors from {d.comments} c join {d.posts} p on p.id = c.post_id
        where c.author_name is not null and c.created_at > {d.ago(hours)} group by c.author_name order by posts_replied_to desc, author limit {int(k)}"""


@operator("ag_specialists")
def specialists(d: Dialect, hours: float = 720, k: int = 15) -> str:
    return f"""with a as (select author_name, submolt, count(*) as n from {d.posts} where author_name is not null and submolt is not null and created_at > {d.ago(hours)} group by author_name, submolt),
        t as (select author_name, count(*) as topics, sum(n) as posts, min(submolt) as only_topic from a group by author_name),
        k as (select author_name, case when topics = 1 and posts >= 5 then 'specialist' when topics >= 3 then 'generalist' end as kind, topics, posts, case when topics = 1 then only_topic end as specialty from t)
        select kind, author_name, topics, posts, specialty from (select *, row_number() over (partition by kind order by posts desc, author_name) as r from k where kind is not null) x where r <= {int(k)}"""


def topic_posts(d: Dialect, topics: list[str], hours: float) -> str:
    """topic, id: every post under each topic it names."""
    return f"select t.topic, p.id from {d.posts} p join {d.values([(t,) for t in topics], ['topic'])} t on lower(p.title) like concat('%', lower(t.topic), '%') or lower(p.content) like concat('%', lower(t.topic), '%') where p.created_at > {d.ago(hours)}"


@operator("ag_topic_graph", as_of="2024-01-05 00:00:00", topics=["with", "that", "und", "que", "ing"])
def topic_graph(d: Dialect, hours: float = 168, topics: list[str] | None = None, k: int = 50) -> str:
    """Topics that share posts: overlap and Jaccard strength."""
    use = topics or GRAPH_TOPICS
    return f"""with m as ({topic_posts(d, use, hours)}), n as (select topic, count(*) as size from m group by topic),
        o as (select a.topic as source, b.topic as target, count(*) as weight from m a join m b on a.id = b.id and a.topic < b.topic group by a.topic, b.topic)
        select source, target, weight, round(weight * 1.0 / (x.size + y.size - weight), 3) as strength, x.size as source_size, y.size as target_size from o join n x on x.topic = o.source join n y on y.topic = o.target order by weight desc, source, target limit {int(k)}"""


@operator("ag_topic_trend", as_of="2024-01-05 00:00:00", topics=[("the", "the"), ("ing", "ing")])
def topic_trend(d: Dialect, hours: float = 24, topics: list | None = None) -> str:
    return f"select topic, count(*) as posts from (select {topic_case(d, topics or TITLE_TOPICS, ('title',))} as topic from {d.posts} where created_at > {d.ago(hours)}) x where topic <> 'other' group by topic"


@operator("ag_status")
def status(d: Dialect) -> str:
    return f"""select posts, comments, oldest, newest, day_posts, round(100.0 * embedded / posts, 1) as coverage,
        case when newest is null then 'never' when age < 1.0 / 24 then 'ok' when age < 0.25 then 'stale' else 'old' end as sync from (
        select count(*) as posts, (select count(*) from {d.comments}) as comments, min(created_at) as oldest, max(created_at) as newest, count(case when created_at > {d.ago(24)} then 1 end) as day_posts,
        (select count(*) from {d.embs}) as embedded, {d.days(d.now, 'max(created_at)')} as age from {d.posts}) x"""


def alert_counts(d: Dialect) -> str:
    return f"""select 'severity' as by_, severity as key, count(*) as n from {d.alerts} where status = 'active' group by severity
        union all select 'type', alert_type, count(*) from {d.alerts} where status = 'active' group by alert_type
        union all select 'last_day', 'all', count(*) from {d.alerts} where detected_at > {d.ago(24)} union all select 'total', 'all', count(*) from {d.alerts}"""


operator("ag_alert_summary")(alert_counts)


@operator("ag_user_merge")
def user_merge(d: Dialect) -> str:
    """One record per user: the first non-empty value of each field."""
    rows = f"select author_name, id, nullif(submolt, 'k0') as a, case when upvotes > 60 then title end as b from {d.posts}"
    return f"""select author_name, max(case when ra = 1 then a end) as a, max(case when rb = 1 then b end) as b from (
        select *, row_number() over (partition by author_name order by case when a is null then 1 else 0 end, id) as ra, row_number() over (partition by author_name order by case when b is null then 1 else 0 end, id) as rb from ({rows}) r) x group by author_name"""


@operator("ag_dedup_first")
def dedup_first(d: Dialect) -> str:
    both = f"select id, 1 as source from {d.posts} where rn % 2 = 0 union all select id, 2 as source from {d.posts}"
    return f"select id, min(source) as source from ({both}) b group by id"


@operator("ag_group_concat")
def group_concat(d: Dialect) -> str:
    return f"select author_name, md5({d.joined('title', ' ')}) as document, count(*) as n from {d.posts} where title is not null group by author_name"


@operator("ag_avg_of_counts")
def avg_of_counts(d: Dialect) -> str:
    return f"select author_name, round(avg(n), 4) as per_thread from (select author_name, post_id, count(*) as n from {d.comments} group by author_name, post_id) x group by author_name"


# Words that say nothing about a narrative.
STOP_WORDS = ["that", "this", "with", "from", "have", "been", "would", "could", "should", "about", "their", "which", "there", "these", "those", "being"]


def top_words(d: Dialect, source: str, key: str, k: int = 5) -> str:
    stop = ", ".join(d.lit(w) for w in STOP_WORDS)
    return f"""select {key}, word, n, r from (select {key}, word, count(*) as n, row_number() over (partition by {key} order by count(*) desc, word) as r from (select {key}, {d.explode(d.tokens('content', 4, 15))} as word from {source}) t
        where word not in ({stop}) group by {key}, word) x where r <= {int(k)}"""


@operator("ag_word_freq")
def word_freq(d: Dialect, k: int = 5) -> str:
    return top_words(d, f"{d.posts}", "submolt", k)


@operator("ag_std_mean")
def std_mean(d: Dialect) -> str:
    return f"select submolt, round(avg(upvotes), 5) as mean, round(stddev_pop(upvotes), 5) as std from {d.posts} group by submolt"

