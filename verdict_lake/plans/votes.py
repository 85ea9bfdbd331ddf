"""Queries on judgments, votes and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging as J
from .registry import query

LATEST = """latest as (select prediction_id, judge_model, max(id) as id, arg_max(verdict, id) as verdict, arg_max(judge_prompt_version, id) as prompt, arg_max(judge_reasoning, id) as reasoning
  from judgments where judge_model is not null group by prediction_id, judge_model)"""
VOTES = LATEST + """, v as (select prediction_id, count(*) as judges, count(distinct verdict) as verdicts, count(*) filter (verdict = 'correct') as c, count(*) filter (verdict = 'incorrect') as i
  from latest group by prediction_id), voted as (select v.*, case when c >= 2 and c > i then 'correct' when i >= 2 and i > c then 'incorrect' end as cv from v)"""
COUNTS = """cc as (select model_id, count(*) filter (cv = 'correct') as correct, count(*) as total from voted join predictions p on p.id = prediction_id
  where error is null and cv is not null {scope} group by model_id),
ag as (select model_id, count(*) filter (judges > 1) as multi, count(*) filter (judges > 1 and verdicts = 1) as unan from voted join predictions p on p.id = prediction_id {also} group by model_id)"""


@query(f"with {LATEST} select prediction_id, judge_model, id, verdict from latest")
def latest_per_judge(t):
    return J.latest_per_judge(t.judgments)


@query("""select id, prediction_id, coalesce(judge_model, '(unknown)') as judge_model, verdict,
  judge_model is not null and id = max(id) over (partition by prediction_id, judge_model) as is_latest from judgments""")
def judgment_history(t):
    return J.judgment_history(t.judgments).select("id", "prediction_id", "judge_model", "verdict", "is_latest")


@query(f"""with {LATEST} select p.model_id, judge_model, count(*) as judged, count(*) filter (verdict = 'correct') as correct,
  count(*) filter (verdict = 'incorrect') as incorrect, round(count(*) filter (verdict = 'correct')::double / count(*), 6) as accuracy
  from latest join predictions p on p.id = prediction_id group by all""")
def judgment_counts(t):
    return J.judgment_counts(t.predictions, t.judgments)


@query(f"with {VOTES}, {COUNTS.format(scope='', also='')} select model_id, correct, total - correct as incorrect, total, round(correct::double / total, 6) as accuracy from cc")
def consensus_counts(t):
    return J.consensus_counts(J.voted_predictions(t.predictions, t.judgments))


VALID = "and post_id in (select r.post_id from reviews r where status = 'validated')"


@query(f"with {VOTES}, {COUNTS.format(scope=VALID, also='')} select model_id, correct, total - correct as incorrect, total, round(correct::double / total, 6) as accuracy from cc")
def consensus_counts_validated(t):
    return J.consensus_counts(J.voted_predictions(t.predictions, t.judgments), t.reviews.filter("status = 'validated'"))


@query(f"with {VOTES}, {COUNTS.format(scope='', also='')} select model_id, multi as judged_by_multiple, unan as unanimous_agreements, round(case when multi = 0 then 0 else unan::double / multi end, 6) as agreement_rate from ag")
def judge_agreement(t):
    return J.judge_agreement(J.voted_predictions(t.predictions, t.judgments))


@query(f"with {VOTES}, {COUNTS.format(scope='', also='where prediction_id % 7 < 3')} select model_id, multi as judged_by_multiple, unan as unanimous_agreements, round(unan::double / multi, 6) as agreement_rate from ag where multi > 0")
def run_agreement(t):
    touched = t.judgments.filter("prediction_id % 7 < 3").select("prediction_id")
    return J.judge_agreement(J.voted_predictions(t.predictions, t.judgments), touched)


BOARD = """select row_number() over (order by correct::double / total desc, cc.model_id) as rank, cc.model_id, 'consensus' as judge_model, correct, total - correct as incorrect, total,
  round(correct::double / total, 6) as accuracy, coalesce(multi, 0) as judged_by_multiple, coalesce(unan, 0) as unanimous_agreements,
  round(case when coalesce(multi, 0) = 0 then 0 else unan::double / multi end, 6) as agreement_rate from cc left join ag using (model_id) where cc.model_id <> 'claude-opus-4-7'"""


@query(f"with {VOTES}, {COUNTS.format(scope='', also='')} {BOARD}")
def leaderboard(t):
    return J.leaderboard(J.voted_predictions(t.predictions, t.judgments)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {VOTES}, {COUNTS.format(scope='', also='')}, b as ({BOARD}) select model_id, correct, incorrect, total, printf('%.1f%%', accuracy * 100) as accuracy_text,
  unanimous_agreements || '/' || judged_by_multiple || ' (' || printf('%.1f%%', agreement_rate * 100) || ')' as agreement_text from b""")
def leaderboard_rows(t):
    return J.leaderboard_rows(J.leaderboard(J.voted_predictions(t.predictions, t.judgments)))


@query("""select model_id, count(*) as n from predictions where model_id <> 'model_3' group by model_id""")
def active_models(t):
    return J.active_models(t.predictions, ("model_3",)).groupBy("model_id").agg(F.count("*").alias("n"))


@query("""with o as (select judge_model, verdict, case when prediction_id % 11 = 0 then 'timeout' end as error from judgments where judge_model is not null)
  select judge_model, count(*) filter (error is null and verdict = 'correct') as correct, count(*) filter (error is null and verdict = 'incorrect') as incorrect,
  count(*) filter (error is not null) as errors, round(100.0 * count(*) filter (error is null and verdict = 'correct') / nullif(count(*) filter (error is null), 0)::double, 6) as accuracy from o group by judge_model""")
def judge_run_stats(t):
    outcomes = t.judgments.filter("judge_model is not null").selectExpr("judge_model", "verdict", "case when prediction_id % 11 = 0 then 'timeout' end as error")
    return J.judge_run_stats(outcomes)


@query(f"""with {VOTES}, l as (select prediction_id, string_agg(judge_model || '=' || verdict, ';' order by judge_model) as verdicts from latest group by prediction_id)
  select p.id as prediction_id, post_id, model_id, coalesce(c, 0) as correct_n, coalesce(i, 0) as incorrect_n, coalesce(l.verdicts, '') as verdicts,
  case when judges is null then 'No judge evaluations yet' when cv is not null then 'Consensus: ' || cv else 'No consensus verdict' end as label
  from predictions p left join voted on voted.prediction_id = p.id left join l on l.prediction_id = p.id where error is null""")
def prediction_comparison(t):
    return J.prediction_comparison(t.predictions, t.judgments)


@query(f"""with {LATEST} select p.id as prediction_id, post_id, model_id, coalesce(count(judge_model), 0) as judges, max(case when judge_model = 'judge_a' then verdict end) as verdict_a,
  max(case when judge_model = 'judge_b' then reasoning end) as reasoning_b from predictions p left join latest on prediction_id = p.id where error is null group by all""")
def predictions_with_verdict_map(t):
    rows = J.predictions_with_verdict_map(t.predictions, t.judgments)
    of = lambda j: F.try_element_at("verdicts", F.lit(j))
    n = F.coalesce(F.size(F.map_keys("verdicts")), F.lit(0))
    return rows.select("prediction_id", "post_id", "model_id", F.when(F.col("verdicts").isNull(), 0).otherwise(n).cast("long").alias("judges"), of("judge_a")["verdict"].alias("verdict_a"), of("judge_b")["reasoning"].alias("reasoning_b"))
