"""The benchmark's tables derived from the given ones, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS = {
    "memes": """select 'p' || cast(o_orderkey as string) as post_id,
  'sub' || cast(o_custkey % 7 as string) as subreddit,
  'title ' || o_orderpriority || ' ' || cast(o_orderkey as string) as title,
  case when o_orderkey % 10 = 9 then null when o_orderkey % 10 = 8 then 'https://example.com/a/' || cast(o_orderkey as string)
       when o_orderkey % 10 = 7 then 'http://i.imgur.com/' || cast(o_orderkey as string) || '.PNG?w=1'
       else 'https://i.redd.it/' || cast(o_orderkey as string) || '.jpg' end as image_url,
  case when o_orderkey % 11 = 10 then null else 'data/images/p' || cast(o_orderkey as string) || '.jpg' end as local_image_path,
  '/r/x/' || cast(o_orderkey as string) as permalink,
  cast(floor(o_totalprice / 1000) as int) as post_score, o_orderdate as created_utc
from orders""",
    "comments": """select 'p' || cast(l_orderkey as string) as post_id,
  'c' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '_' || cast(l_partkey as string) || '_' || cast(l_suppkey as string) as comment_id,
  case when l_suppkey % 50 = 0 then 'AutoModerator' when l_suppkey % 50 = 1 then 'BotHelper' else 'u' || cast(l_suppkey as string) end as author,
  case when l_linenumber = 7 and l_returnflag = 'R' then '[deleted]' when l_linenumber = 6 then 'see https://i.redd.it/x' || cast(l_partkey as string) || '.png ok'
       else 'about ' || cast(l_partkey as string) end as body,
  cast(floor(l_quantity) as int) - 5 as score,
  case when l_returnflag = 'A' and l_suppkey % 5 = 0 then 'moderator' end as distinguished
from lineitem""",
    "ground_truths": """select 'p' || cast(o_orderkey as string) as post_id,
  'explanation of ' || cast(o_orderkey as string) as explanation,
  case when o_custkey % 50 = 0 then null else cast(o_custkey % 41 as double) / 40 end as consensus_confidence,
  cast(o_custkey % 6 as int) + 1 as num_agreeing_comments,
  'model_' || cast(o_custkey % 3 as string) as consensus_model
from orders where o_orderkey % 3 <> 0""",
    "sources": """select post_id, '["' || min(comment_id) || '","' || max(comment_id) || '","' || case when count(*) % 3 = 0 then 'gone' else min(comment_id) end || '"]' as source_comment_ids
from (select 'p' || cast(l_orderkey as string) as post_id,
  'c' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '_' || cast(l_partkey as string) || '_' || cast(l_suppkey as string) as comment_id
  from lineitem where l_orderkey % 3 <> 0) x group by post_id""",
    "reviews": """select 'p' || cast(o_orderkey as string) as post_id,
  case when o_orderstatus = 'F' then 'validated' else 'excluded' end as status,
  case when o_orderstatus = 'F' then null when o_orderpriority like '1%' then 'safety: slur' when o_orderpriority like '2%' then 'auto: nonsense'
       when o_orderpriority like '3%' then 'image_missing' when o_orderpriority like '4%' then null else 'duplicate_image:p1' end as reason
from orders where o_orderstatus <> 'O' and (o_orderstatus = 'P' or o_orderkey % 3 <> 0)""",
    "predictions": """select l_orderkey * 10 + l_linenumber % 4 as id, 'p' || cast(l_orderkey as string) as post_id,
  'model_' || cast(l_linenumber % 4 as string) as model_id,
  'prediction ' || cast(l_orderkey * 10 + l_linenumber % 4 as string) as prediction,
  case when max(l_quantity) < 12 then 'timeout' end as error
from lineitem group by l_orderkey, l_linenumber % 4""",
    "judgments": """select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 3 + j as id,
  l_orderkey * 10 + l_linenumber % 4 as prediction_id,
  case when l_partkey % 97 = 0 then null when j = 0 then 'judge_a' when j = 1 then 'judge_b' else 'x/judge_c' end as judge_model,
  case when ((l_orderkey + l_linenumber % 4) % 10 < 4 + l_linenumber % 4) <> ((l_suppkey + j) % 4 = 0) then 'correct' else 'incorrect' end as verdict,
  'because ' || cast(l_partkey as string) as judge_reasoning,
  'prompt_' || cast(l_partkey % 2 as string) as judge_prompt_version, l_shipdate as judged_at
from lineitem cross join (select 0 as j union all select 1 union all select 2) judges
where not (j = 2 and l_suppkey % 3 = 0)""",
    "calls": """select event_id as id, role, 'p' || cast(user_id as string) as post_id, 'model_' || cast(k as string) as model,
  'prompt_' || cast(event_id % 2 as string) as prompt_version, 's' || cast(event_id % 50 as string) as session_id,
  case when role = 'predictor' then 'prediction ' || cast(user_id * 10 + k as string) else 'answer ' || cast(event_id % 9 as string) end as response,
  case when event_type = 'error' then 'timeout' end as error,
  case when event_type = 'error' then null when role = 'safety_gate' then case when event_id % 3 = 0 then 'exclude' else 'keep' end
       when role = 'consensus' then case when event_id % 3 = 0 then 'no_consensus' else 'consensus' end end as verdict,
  'reason ' || cast(event_id % 5 as string) as reasoning, cast(floor(value) as bigint) as latency_ms
from (select *, event_id % 4 as k, case cast(floor(event_id / 4) as int) % 4 when 0 then 'safety_gate' when 1 then 'consensus' when 2 then 'predictor' else 'quality_gate' end as role
  from events) e""",
    "states": """select 'p' || cast(o_orderkey as string) as post_id, 'consensus' as stage, 'model_' || cast(o_custkey % 2 as string) as model, 'prompt_0' as prompt_version,
  case when o_orderkey % 10 = 0 then 'consensus' else 'no_consensus' end as status from orders where o_orderkey % 5 in (0, 1)
union all select 'p' || cast(o_orderkey as string), 'safety', 'model_0', 'prompt_' || cast(o_custkey % 2 as string),
  case when o_orderkey % 8 = 0 then 'excluded' else 'passed' end from orders where o_orderkey % 4 = 0""",
    "tags": """select tag_id, case when tag_id % 2 = 0 then 'Tag ' else 'tag ' end || cast(tag_id as string) as name, case when tag_id % 3 = 0 then null else 'about tags' end as description
from (select distinct l_partkey % 13 as tag_id from lineitem) t union all select 13, 'Unused', null""",
    "meme_tags": """select 'p' || cast(l_orderkey as string) as post_id, l_partkey % 13 as tag_id, max('note ' || cast(l_linenumber as string)) as notes
from lineitem where l_partkey % 3 = 0 group by l_orderkey, l_partkey % 13""",
    "eval_items": """select 'p' || cast(o_orderkey as string) as post_id,
  case o_custkey % 4 when 0 then 'hard_yes_consensus' when 1 then 'true_no_consensus' when 2 then 'bad_gloss' else 'false_positive_consensus' end as category,
  o_custkey % 4 in (0, 2) as expected_has_consensus,
  case when o_custkey % 4 in (0, 2) then 'expected ' || cast(o_orderkey as string) end as expected_explanation,
  case when o_custkey % 5 = 0 then null else 'note' end as notes, o_custkey % 7 <> 0 as active, o_orderdate as updated_at
from orders where o_orderkey % 4 = 1""",
    "eval_results": """select 'run_' || cast(j as string) as run_id, post_id, category, expected_has_consensus,
  (n + j) % 3 <> 0 as actual_has_consensus, ((n + j) % 3 <> 0) = expected_has_consensus as passed, j as run_order
from (select 'p' || cast(o_orderkey as string) as post_id, o_orderkey as n,
  case o_custkey % 4 when 0 then 'hard_yes_consensus' when 1 then 'true_no_consensus' when 2 then 'bad_gloss' else 'false_positive_consensus' end as category,
  o_custkey % 4 in (0, 2) as expected_has_consensus from orders where o_orderkey % 4 = 1) i
cross join (select 0 as j union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) r""",
    "regressions": """select 'p' || cast(o_orderkey as string) as post_id,
  case o_custkey % 3 when 0 then 'wrong' when 1 then 'partial' else 'right' end as status,
  case when o_custkey % 2 = 0 then 'canonical ' || cast(o_orderkey as string) end as canonical_explanation,
  case when o_custkey % 5 = 0 then null else 'missed the pun' end as failure_modes, 'see notes' as reviewer_notes,
  case when o_orderkey % 2 = 0 then ' explanation of ' || cast(o_orderkey as string) || ' ' else 'older text' end as consensus_at_annotation, o_orderdate as annotated_at
from orders where o_orderkey % 9 = 2""",
    "feedback": """select 'p' || cast(o_orderkey as string) as post_id, case o_custkey % 3 when 0 then 'safety' when 1 then 'quality' else 'consensus' end as gate,
  case o_custkey % 4 when 0 then 'no_consensus' when 1 then 'exclude' when 2 then 'consensus' end as gate_decision,
  case o_custkey % 5 when 0 then 'No consensus here' when 1 then 'Consensus' when 2 then 'keep' when 3 then null else 'a longer decision' end as correct_decision,
  'line one' || chr(10) || 'line two ' || cast(o_orderkey as string) as notes, o_orderdate as created_at
from orders where o_orderkey % 9 in (2, 3)""",
    "batch_memes": """select 'b' || cast(o_orderkey % 20 as string) as batch_id, 'p' || cast(o_orderkey as string) as post_id, o_orderkey as position,
  case o_custkey % 5 when 0 then 'prediction_error' when 1 then 'judged' when 2 then 'consensus' else 'fetched' end as stage_status
from orders where o_orderkey % 3 <> 1""",
    "snapshot_memes": """select 'snap_' || cast(o_orderkey % 2 as string) as snapshot_id, 'p' || cast(o_orderkey as string) as post_id
from orders where o_orderstatus = 'F' and o_orderkey % 3 <> 0""",
}


def needed(names: set[str]) -> list[str]:
    return [n for n in VIEWS if n in names]


def with_views(sql: str) -> str:
    """sql (a select, or one with its own leading with) after the definitions of the views that it names."""
    used = needed(set(re.findall(r"\b\w+\b", sql)))
    heads = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    if not heads:
        return sql
    body = sql.strip()
    return f"with {heads}, {body[5:]}" if body.lower().startswith("with ") else f"with {heads} {body}"


class Tables:
    """The views as DataFrames: Tables(spark, sf_dir).memes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        for raw in RAW:
            if re.search(rf"\bfrom {raw}\b", VIEWS[name]):
                self.spark.read.parquet(f"{self.sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
        return self.spark.sql(VIEWS[name])
