"""Queries on sources, filters, states and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as MO
from ..functions import urls as U
from ..operators import numbering, status as S
from ..sources import listings as L
from .registry import query

_URLS = "select post_id, image_url as url from memes"


@query("""select post_id, coalesce(regexp_matches(split_part(lower(image_url), '?', 1), '\\.(jpg|jpeg|png|gif|webp)$') or contains(lower(image_url), 'i.redd.it') or contains(lower(image_url), 'i.imgur.com'), false) as is_image from memes""")
def is_image_url(t):
    return t.memes.select("post_id", U.is_image_url(F.col("image_url")).alias("is_image"))


@query("""select post_id, case when image_url is null or not image_url like 'https://%' then 'image URL must use https'
  when regexp_extract(image_url, '^https://([^/]+)', 1) not in ('i.redd.it', 'preview.redd.it', 'i.imgur.com', 'i.imgflip.com') then 'image host not allowed: ' || regexp_extract(image_url, '^https://([^/]+)', 1) end as reason from memes""")
def allowed_image_source(t):
    return t.memes.select("post_id", U.image_source_error(F.col("image_url")).alias("reason"))


@query("""select post_id, case when lower(regexp_extract(split_part(image_url, '?', 1), '\\.([A-Za-z]+)$', 1)) in ('png', 'gif', 'webp', 'jpeg') then lower(regexp_extract(split_part(image_url, '?', 1), '\\.([A-Za-z]+)$', 1)) else 'jpg' end as ext from memes""")
def image_extension(t):
    return t.memes.select("post_id", U.image_extension(F.col("image_url")).alias("ext"))


@query("""select post_id, count(*) as urls from (select post_id, unnest(regexp_extract_all(body, 'https?://i\\.redd\\.it/[^\\s)\\]]+')) as u from comments) group by post_id""")
def extract_image_urls(t):
    return t.comments.select("post_id", F.explode(U.image_urls(F.col("body"))).alias("u")).groupBy("post_id").agg(F.count("*").alias("urls"))


POST_JSON = """struct(array(struct(struct(concat('t3_', post_id) as name, subreddit, image_url as url, title, permalink, case when post_score % 13 = 0 then null else post_score end as score,
  post_score % 6 as num_comments, cast(unix_timestamp(created_utc) as double) as created_utc) as data)) as children) as data"""


def _listing(t):
    return t.memes.select(F.to_json(F.expr(f"struct({POST_JSON})")).alias("value"))


POST_SQL = "select post_id, subreddit, title, image_url as url, permalink, cast(case when post_score % 13 = 0 then 0 else post_score end as bigint) as score, cast(post_score % 6 as bigint) as num_comments, cast(created_utc as varchar) as created_at from memes"


@query(POST_SQL)
def read_posts_listing(t):
    return L.read_posts_listing(_listing(t)).withColumn("created_at", F.col("created_at").cast("string"))


@query(f"""with p as ({POST_SQL}) select post_id, score, num_comments from p where score >= 10 and num_comments >= 3
  and (regexp_matches(split_part(lower(url), '?', 1), '\\.(jpg|jpeg|png|gif|webp)$') or contains(lower(url), 'i.redd.it') or contains(lower(url), 'i.imgur.com'))""")
def qualify_posts(t):
    return L.qualify_posts(L.read_posts_listing(_listing(t))).select("post_id", "score", "num_comments")


@query("select post_id from memes where created_utc >= timestamp '1996-01-01' and created_utc < timestamp '1997-03-01'")
def date_window(t):
    return L.date_window(t.memes, "created_utc", "1996-01-01", "1997-03-01").select("post_id")


COMMENT_ROWS = "select post_id, comment_id, author, body, cast(score as bigint) as score, distinguished from comments where score % 4 <> 0"


@query(COMMENT_ROWS)
def read_comments_listing(t):
    kind = "case when score % 4 = 0 then 'more' else 't1' end"
    child = f"struct({kind} as kind, struct(concat('t1_', comment_id) as name, author, body, distinguished, score) as data)"
    pair = f"array(struct(struct(cast(array() as array<struct<kind:string,data:struct<name:string,author:string,body:string,distinguished:string,score:int>>>) as children) as data), struct(struct(array({child}) as children) as data))"
    return L.read_comments_listing(t.comments.select("post_id", F.to_json(F.expr(pair)).alias("value")))


@query("""select comment_id, author, body, cast(score as bigint) as score from comments where author <> 'AutoModerator' and not lower(author) like 'bot%' and body not in ('[deleted]', '[removed]') and distinguished is null""")
def clean_comments(t):
    return L.clean_comments(t.comments).select("comment_id", "author", "body", "score")


@query("""select post_id, subreddit, case when post_score % 4 <> 0 and (regexp_matches(split_part(lower(image_url), '?', 1), '\\.(jpg|jpeg|png|gif|webp)$') or contains(lower(image_url), 'i.redd.it') or contains(lower(image_url), 'i.imgur.com')) then image_url end as image_url,
  cast(post_score as bigint) as score, cast(epoch(created_utc) as bigint) as created_utc from memes where post_score % 9 <> 0""")
def read_archive_rows(t):
    row = """struct(post_id as id, subreddit, title, image_url as url, post_score % 4 = 0 as is_self, post_score as score,
      case when post_score % 9 = 0 then '0' else cast(unix_timestamp(created_utc) as string) end as created_utc)"""
    return L.read_archive_rows(t.memes.select(F.to_json(F.expr(row)).alias("value"))).select("post_id", "subreddit", "image_url", "score", "created_utc")


STATE_SQL = """select m.post_id, case when r.status = 'validated' then 'validated' when r.status = 'excluded' then case when starts_with(coalesce(reason, ''), 'safety:') then 'safety_excluded'
  when starts_with(coalesce(reason, ''), 'auto:') then 'quality_excluded' when reason = 'image_missing' then 'image_missing' else 'human_excluded' end
  when g.post_id is not null then 'unreviewed' when cc.post_id is not null then 'no_consensus' else 'pending' end as state
  from memes m left join reviews r using (post_id) left join ground_truths g using (post_id) left join (select distinct post_id from calls where role = 'consensus') cc using (post_id)"""


@query(STATE_SQL)
def classify_state(t):
    return S.classify_state(t.memes, t.ground_truths, t.reviews, t.calls)


@query("""with l as (select m.post_id, subreddit, title, coalesce(r.status, case when g.post_id is null then 'no_consensus' else 'unreviewed' end) as review_status from memes m left join reviews r using (post_id) left join ground_truths g using (post_id))
  select * from l where review_status = 'unreviewed' and subreddit = 'sub3' and title ilike '%urgent%' order by post_id limit 20 offset 20""")
def review_status_listing(t):
    rows = S.review_status_listing(t.memes, t.ground_truths, t.reviews, "unreviewed", "sub3", "urgent")
    return S.page(rows, [F.col("post_id")], 20, 1)


@query("""select (select count(*) from memes) as total, (select count(*) from ground_truths) as with_consensus, (select count(*) from reviews where status = 'validated') as validated,
  (select count(*) from reviews where status = 'excluded') as excluded, (select count(*) from ground_truths where post_id not in (select post_id from reviews)) as unreviewed""")
def status_counts(t):
    return S.status_counts(t.memes, t.ground_truths, t.reviews)


@query("""with ready as (select g.post_id from ground_truths g join reviews r on r.post_id = g.post_id and status = 'validated')
  select model_id, count(*) as predicted, (select count(*) from ready) as available, (select count(*) from ready) - count(*) as remaining from predictions where error is null and post_id in (select post_id from ready) group by model_id""")
def prediction_counts(t):
    return S.prediction_counts(t.predictions, t.ground_truths, t.reviews)


@query("""with s as (select coalesce(num_agreeing_comments, 0) as k, coalesce(consensus_confidence, 0) as c, row_number() over (order by coalesce(num_agreeing_comments, 0)) as rn, count(*) over () as n from ground_truths)
  select max(n) as n, round(avg(c), 4) as mean_confidence, cast(max(case when rn = n // 2 + 1 then k end) as bigint) as upper_median_agreeing from s""")
def consensus_quality(t):
    return S.consensus_quality(t.ground_truths)


@query("""with b as (select cast(least(9, trunc(coalesce(consensus_confidence, 0) * 10)) as int) as bin from ground_truths) select cast(r.range as int) as bin, count(b.bin) as n from range(10) r left join b on b.bin = r.range group by all""")
def confidence_histogram(t):
    return S.confidence_histogram(t.ground_truths)


@query("select batch_id, stage_status, count(*) as n from batch_memes group by all")
def batch_stage_counts(t):
    return S.batch_stage_counts(t.batch_memes)


@query("""with p as (select * from predictions where model_id = 'model_1' and error is null)
  select batch_id, count(*) as posts, count(g.post_id) as consensus, cast(sum(coalesce(pn, 0)) as bigint) as predictions, count(*) filter (stage_status = 'prediction_error') as prediction_errors, cast(sum(coalesce(jn, 0)) as bigint) as judgments
  from batch_memes b left join ground_truths g using (post_id) left join (select post_id, count(*) as pn from p group by post_id) using (post_id)
  left join (select post_id, count(*) as jn from p join judgments j on j.prediction_id = p.id group by post_id) using (post_id) group by batch_id""")
def batch_summary(t):
    return S.batch_summary(t.batch_memes, t.ground_truths, t.predictions, t.judgments, "model_1")


@query("select 'regression' as kind, status as value, count(*) as n from regressions group by status union all select 'misfire', gate, count(*) from feedback group by gate")
def flag_counts(t):
    return S.flag_counts(t.regressions, t.feedback)


@query("select distinct model_id from predictions where error is null and post_id in (select post_id from snapshot_memes where snapshot_id = 'snap_0')")
def snapshot_models(t):
    return S.snapshot_models(t.predictions, t.snapshot_memes.filter("snapshot_id = 'snap_0'"))


@query("select id, role, post_id, error from calls where role = 'consensus' and session_id = 's5' and error is not null order by id desc limit 10")
def call_log_filter(t):
    return S.call_log_filter(t.calls, role="consensus", session_id="s5", errors_only=True, newest=10).select("id", "role", "post_id", "error")


_NEWEST = "(select *, row_number() over (partition by post_id, role order by id desc) as rn from calls where role in ('safety_gate', 'quality_gate', 'consensus'))"


@query(f"select post_id, role, id, verdict, reasoning, error from {_NEWEST} where rn = 1")
def latest_call_per_role(t):
    return S.latest_call_per_role(t.calls)


@query(f"""with st as ({STATE_SQL}), c as (select * from {_NEWEST} where rn = 1 and role = 'consensus') select st.post_id,
  case when c.post_id is not null then coalesce(verdict, case when coalesce(error, '') <> '' then 'error' end) when state = 'no_consensus' then 'no_consensus' end as gate_decision from st left join c using (post_id)""")
def gate_decision_lookup(t):
    states = S.classify_state(t.memes, t.ground_truths, t.reviews, t.calls)
    return S.gate_decision_lookup(states, S.latest_call_per_role(t.calls), "consensus")


@query("""with l as (select *, row_number() over (partition by post_id, role, model, prompt_version order by id desc) as rn from calls where role in ('safety_gate', 'consensus') and verdict is not null and error is null)
  select post_id, case role when 'safety_gate' then 'safety' else 'consensus' end as stage, model, prompt_version, case verdict when 'keep' then 'passed' when 'exclude' then 'excluded' else verdict end as status, reasoning, id as llm_call_id from l where rn = 1""")
def backfill_state(t):
    return S.backfill_state(t.calls)


@query("""select 'new posts' as name, count(*) as n from memes where post_id not in (select post_id from reviews) union all select 'new comments', count(*) from (select distinct comment_id from comments where score < 0)
  union all select stage || ' ' || status, count(*) from states group by stage, status""")
def ingest_stats(t):
    from ..operators.merge import merge, merge_counts

    posts = merge(t.reviews.select("post_id", F.lit("x").alias("v")), t.memes.selectExpr("post_id", "'x' as v", "0 as seq"), ["post_id"], "insert_if_absent")
    old = t.comments.filter("score >= 0").select("comment_id", F.lit("x").alias("v")).distinct()
    fresh = t.comments.filter("score < 0").selectExpr("comment_id", "'x' as v", "0 as seq")
    comments = merge(old.join(fresh, "comment_id", "left_anti"), fresh, ["comment_id"], "insert_if_absent")
    return S.ingest_stats(merge_counts(posts, "posts"), merge_counts(comments, "comments"), t.states)


@query("select 'subreddit' as facet, subreddit as value from memes group by subreddit union all select 'model', model_id from predictions group by model_id")
def facets(t):
    return S.facets(t.memes, t.predictions)


@query("select post_id, title from memes where post_id in (select post_id from reviews where status = 'validated') order by title, post_id limit 200")
def validated_by_title(t):
    return S.validated_by_title(t.memes, t.reviews, 200)


_MODELS = "select distinct case o_custkey % 8 when 0 then 'claude-x' when 1 then ' Muse Spark 1.1' when 2 then 'meta/muse-2' when 3 then 'x/judge' when 4 then 'gpt-5' when 5 then 'o4' when 6 then 'meta-muse-3' else 'llama' end as model_id from orders"


@query(f"""select model_id, case when starts_with(model_id, 'claude') then 'anthropic' when lower(trim(model_id)) in ('muse spark 1.1', 'muse-spark-1.1') or regexp_matches(lower(trim(model_id)), '^(muse-|meta-muse-|meta/muse-)') then 'meta'
  when contains(model_id, '/') then 'openrouter' else 'openai' end as target, case when regexp_matches(model_id, '^(gpt-|o)') then 'openai' when starts_with(model_id, 'claude-') then 'anthropic' when contains(model_id, '/') then 'openrouter' end as judge,
  case when lower(trim(model_id)) = 'muse spark 1.1' then 'muse-spark-1.1' else trim(model_id) end as canonical from ({_MODELS})""")
def route_models(t):
    t.orders.createOrReplaceTempView("orders")
    m = F.col("model_id")
    return t.spark.sql(_MODELS).select(m, MO.target_provider(m).alias("target"), MO.judge_provider(m).alias("judge"), MO.canonical_model(m).alias("canonical"))


_ERRORS = "select event_id as id, case event_id % 5 when 0 then 'insufficient_quota' when 1 then 'rate_limit' when 2 then null else 'server' end as code, case event_id % 7 when 0 then 401 when 1 then 429 when 2 then 503 when 3 then null else 418 end as status from events"


@query(f"""select id, case when code is null and status is null then null when coalesce(code = 'insufficient_quota', false) or coalesce(status in (401, 402, 403), false) then 'fatal'
  when coalesce(status in (429, 500, 502, 503), false) then 'retryable' else 'other' end as kind from ({_ERRORS})""")
def classify_call_errors(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_ERRORS).select("id", MO.error_kind(F.col("code"), F.col("status")).alias("kind"))


@query("select post_id, printf('meme_%05d', row_number() over (order by post_id)) as display from ground_truths")
def display_index(t):
    rows = numbering.numbered(t.ground_truths.select("post_id"), "post_id")
    return rows.select("post_id", numbering.display_index().alias("display"))
