"""Queries on work queues and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import queues as Q
from ..operators.judging import latest_per_judge
from ..operators.keyed_table import KeyedTable
from ..session import scratch_folder
from .registry import query
from .votes import LATEST

NOT_IN = "post_id not in (select post_id from {})"


@query("""select post_id from memes m where not exists (select 1 from reviews r where r.post_id = m.post_id) and not exists (select 1 from ground_truths g where g.post_id = m.post_id)""")
def pending_gate(t):
    return Q.pending_gate(t.memes, t.reviews, t.ground_truths)


@query("""select post_id from memes m where not exists (select 1 from reviews r where r.post_id = m.post_id) and not exists (select 1 from ground_truths g where g.post_id = m.post_id)
  and not exists (select 1 from states s where s.post_id = m.post_id and stage = 'safety' and model = 'model_0' and prompt_version = 'prompt_1')""")
def pending_gate_by_state(t):
    return Q.pending_gate(t.memes, t.reviews, t.ground_truths, t.states, "model_0", "prompt_1")


@query("""select post_id from memes m where not exists (select 1 from ground_truths g where g.post_id = m.post_id) and not exists (select 1 from reviews r where r.post_id = m.post_id and status = 'excluded')
  and not exists (select 1 from states s where s.post_id = m.post_id and stage = 'consensus' and model = 'model_1' and prompt_version = 'prompt_0')""")
def pending_consensus(t):
    return Q.pending_consensus(t.memes, t.reviews, t.ground_truths, t.states, "model_1", "prompt_0")


READY = "ready as (select g.post_id from ground_truths g join reviews r on r.post_id = g.post_id and status = 'validated')"


@query(f"""with {READY}, m as (select distinct model_id from predictions) select ready.post_id, m.model_id from ready cross join m
  where not exists (select 1 from predictions p where p.post_id = ready.post_id and p.model_id = m.model_id and error is null)""")
def pending_predictions(t):
    return Q.pending_predictions(t.reviews, t.ground_truths, t.predictions, Q.few(t.predictions, "model_id"))


@query(f"""with {READY}, m as (select 'model_2' as model_id) select ready.post_id, m.model_id from ready cross join m where ready.post_id in (select post_id from snapshot_memes where snapshot_id = 'snap_1')
  and not exists (select 1 from predictions p where p.post_id = ready.post_id and p.model_id = m.model_id and error is null)""")
def pending_predictions_snapshot(t):
    return Q.pending_predictions(t.reviews, t.ground_truths, t.predictions, ["model_2"], t.snapshot_memes.filter("snapshot_id = 'snap_1'"))


@query("""select position, b.post_id from batch_memes b where batch_id = 'b3' and post_id in (select post_id from ground_truths) and post_id not in (select post_id from reviews where status = 'excluded')
  and post_id not in (select post_id from predictions where model_id = 'model_1' and error is null)""")
def pending_in_order(t):
    return Q.pending_in_order(t.batch_memes.filter("batch_id = 'b3'"), t.ground_truths, t.reviews, t.predictions, "model_1")


@query("""with js as (select distinct judge_model from judgments where judge_model is not null) select p.id as prediction_id, js.judge_model from predictions p cross join js
  where error is null and post_id in (select post_id from reviews where status = 'validated')
  and not exists (select 1 from judgments j where j.prediction_id = p.id and j.judge_model = js.judge_model)""")
def pending_judgments(t):
    return Q.pending_judgments(t.predictions, t.judgments, Q.few(t.judgments, "judge_model"), t.reviews)


@query("""with js as (select distinct judge_model from judgments where judge_model is not null) select p.id as prediction_id, js.judge_model from predictions p cross join js
  where error is null and post_id in (select post_id from batch_memes where batch_id = 'b5')
  and not exists (select 1 from judgments j where j.prediction_id = p.id and j.judge_model = js.judge_model)""")
def pending_judgments_scoped(t):
    return Q.pending_judgments(t.predictions, t.judgments, Q.few(t.judgments, "judge_model"), posts=t.batch_memes.filter("batch_id = 'b5'"))


@query("""select p.id as prediction_id from predictions p where error is null and post_id in (select post_id from reviews where status = 'validated')
  and not exists (select 1 from judgments j where j.prediction_id = p.id and j.prediction_id % 3 <> 0)""")
def unjudged(t):
    return Q.unjudged(t.predictions, t.judgments.filter("prediction_id % 3 <> 0"), t.reviews)


@query(f"with {LATEST} select distinct prediction_id from latest where prompt = 'prompt_0'")
def pending_rejudgments(t):
    return Q.pending_rejudgments(latest_per_judge(t.judgments, "judge_prompt_version"), "prompt_0")


@query("""select post_id, 'excluded' as status, 'image_missing' as reason from memes where local_image_path is null and post_id in (select post_id from ground_truths) and post_id not in (select post_id from reviews)""")
def missing_images(t):
    return Q.missing_images(t.memes, t.ground_truths, t.reviews)


@query("select count(*) as remaining from ground_truths where post_id not in (select post_id from reviews)")
def review_queue(t):
    return Q.remaining(Q.review_queue(t.ground_truths, t.reviews))


@query("""select post_id from (select post_id from ground_truths where post_id not in (select post_id from reviews)) order by sha256('pick' || post_id) limit 1""")
def review_pick(t):
    return Q.seeded_pick(Q.review_queue(t.ground_truths, t.reviews), 1, "pick")


@query("""with c as (select post_id, min(score * 1000 + length(comment_id)) as seen from comments group by post_id)
  select row_number() over (order by seen, post_id) as position, post_id from (select * from c where post_id not in (select post_id from reviews) order by seen, post_id limit 40)""")
def first_n_new_posts(t):
    candidates = t.comments.selectExpr("post_id", "score * 1000 + length(comment_id) as seen")
    return Q.first_new_posts(candidates, t.reviews, 40).withColumn("position", F.col("position").cast("long"))


TARGET = "select id, 'p' || id as k, 'old' || id as v, case when id % 4 = 0 then 'timeout' end as error, 'c' || id as created_at from predictions where id % 3 <> 0"


def _target(t):
    return t.predictions.filter("id % 3 <> 0").selectExpr("id", "'old' || cast(id as string) as v", "case when id % 4 = 0 then 'timeout' end as error", "'c' || cast(id as string) as created_at")


def _updates(t):
    return t.judgments.filter("prediction_id % 2 = 0").selectExpr("prediction_id as id", "case when id % 5 = 0 then null else 'new' || cast(id as string) end as v", "cast(null as string) as error", "'u' || cast(id as string) as created_at", "id as seq")


_MERGE = """with tgt as (select id, 'old' || id as v, case when id % 4 = 0 then 'timeout' end as error, 'c' || id as created_at from predictions where id % 3 <> 0),
u as (select prediction_id as id, case when id % 5 = 0 then null else 'new' || id end as v, cast(null as varchar) as error, 'u' || id as created_at,
  row_number() over (partition by prediction_id order by id {dir}) as rn from judgments where prediction_id % 2 = 0),
n as (select * from u where rn = 1), f as (select coalesce(tgt.id, n.id) as id, tgt.id is not null as has_old, n.id is not null as has_new, tgt.v as ov, tgt.error as oe, tgt.created_at as oc, n.v as nv, n.error as ne, n.created_at as nc
  from tgt full join n on tgt.id = n.id), x as (select *, {use} as use_new from f)
select id, {v} as v, case when use_new then ne else oe end as error, {c} as created_at, case when not use_new then 'kept' when has_old then 'updated' else 'inserted' end as merge_action from x"""


def merge_sql(use: str, direction: str = "desc", v: str = "case when use_new then nv else ov end", c: str = "case when use_new then nc else oc end") -> str:
    return _MERGE.format(dir=direction, use=use, v=v, c=c)


@query(merge_sql("has_new and not has_old", "asc"))
def merge_insert_if_absent(t):
    return M.merge(_target(t), _updates(t), ["id"], "insert_if_absent")


@query("""select 'p' || o_orderkey as post_id, case when r.post_id is null then 'inserted' else 'kept' end as merge_action, coalesce(r.reason, case when r.post_id is null then 'image_missing' end) as reason
  from orders left join reviews r on r.post_id = 'p' || o_orderkey where r.post_id is not null or o_orderkey % 11 = 10""")
def merge_auto_exclusions(t):
    new = t.memes.filter("local_image_path is null").selectExpr("post_id", "'excluded' as status", "'image_missing' as reason", "0 as seq")
    return M.merge(t.reviews, new, ["post_id"], "insert_if_absent").select("post_id", "merge_action", "reason")


def _stored(t) -> KeyedTable:
    """The target as a stored table in buckets."""
    table = KeyedTable(t.spark, scratch_folder(t.spark), "id long, v string, error string, created_at string", ["id"], buckets=32)
    table.merge(_target(t).withColumn("seq", F.lit(0)), "replace")
    return table


def _stored_sql(use: str) -> str:
    return f"select id, v, error, created_at from ({merge_sql(use)})"


@query(_stored_sql("has_new"))
def stored_merge_replace(t):
    """A stored table after a merge, and after the same one again."""
    table = _stored(t)
    for _ in range(2):
        table.merge(_updates(t), "replace")
    return table.read()


@query(_stored_sql("has_new and (not has_old or oe is not null)"))
def stored_merge_only_failures(t):
    table = _stored(t)
    table.merge(_updates(t), "replace_only_failures", failed=F.col("old.error").isNotNull())
    return table.read()


@query(f"select id, v, error, created_at from ({merge_sql('has_new')}) where id not in (select prediction_id from judgments where id % 7 = 0)")
def stored_delete(t):
    table = _stored(t)
    table.merge(_updates(t), "replace")
    table.delete(t.judgments.filter("id % 7 = 0").selectExpr("prediction_id as id"))
    return table.read()


@query(merge_sql("has_new"))
def merge_replace(t):
    return M.merge(_target(t), _updates(t), ["id"], "replace")


@query(merge_sql("has_new and (not has_old or oe is not null)"))
def merge_replace_only_failures(t):
    return M.merge(_target(t), _updates(t), ["id"], "replace_only_failures", failed=F.col("old.error").isNotNull())


@query(merge_sql("has_new", c="coalesce(oc, nc)"))
def merge_replace_keep_created(t):
    return M.merge(_target(t), _updates(t), ["id"], "replace_keep_created")


@query(merge_sql("has_new", v="coalesce(case when use_new then nv else ov end, ov)"))
def merge_coalesce_update(t):
    return M.merge(_target(t), _updates(t), ["id"], "coalesce_update", coalesced=["v"])


@query("select post_id, status, reason from reviews where post_id not in (select post_id from regressions)")
def delete_keys(t):
    return M.delete_keys(t.reviews, t.regressions, ["post_id"])
