"""Queries on search, prompts, answers, duplicates, snapshots, audits, tags and the evaluation set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes as H
from ..operators import audit as A
from ..operators import consensus as C
from ..operators import duplicates as D
from ..operators import evalset as E
from ..operators import inspect as I
from ..operators import responses as R
from ..operators import snapshot as X
from ..operators import tags as G
from ..operators.judging import voted_predictions
from ..operators.queues import few, pending_judgments
from ..operators.status import classify_state
from ..operators.text_index import TextIndex, texts_of
from ..session import scratch_folder
from .posts import STATE_SQL
from .registry import query
from .votes import BOARD, COUNTS, LATEST, VOTES

# search and filters


@query("select post_id from memes where post_id in (select post_id from predictions where error is null and model_id = 'model_1')")
def prediction_coverage(t):
    return I.prediction_coverage(t.memes.select("post_id"), t.predictions, True, "model_1")


@query("select post_id from memes where post_id not in (select post_id from predictions p where error is null and exists (select 1 from judgments j where j.prediction_id = p.id))")
def evaluation_coverage(t):
    return I.evaluation_coverage(t.memes.select("post_id"), t.predictions, t.judgments, False)


CLASS = f"""{LATEST}, b as (select prediction_id, count(*) filter (verdict = 'correct') - count(*) filter (verdict = 'incorrect') as s from latest group by prediction_id),
cls as (select post_id, case when bool_or(s > 0) and bool_or(s < 0) then 'mixed' when bool_or(s > 0) then 'all_correct' else 'all_incorrect' end as verdict_class
  from b join predictions p on p.id = prediction_id where error is null and s <> 0 group by post_id)"""


@query(f"with {CLASS} select post_id, verdict_class from cls")
def verdict_class(t):
    return I.verdict_class(t.predictions, t.judgments)


_NAMED = "select post_id from meme_tags join tags using (tag_id) where lower(name) in ('tag 2', 'tag 5')"


@query(f"select post_id from memes where post_id in ({_NAMED})")
def tag_filter_any(t):
    return I.tag_filter(t.memes.select("post_id"), t.tags, t.meme_tags, "any", ["TAG 2", "tag 5"])


@query(f"select post_id from ({_NAMED}) group by post_id having count(*) = 2")
def tag_filter_all(t):
    return I.tag_filter(t.memes.select("post_id"), t.tags, t.meme_tags, "all_tags", ["TAG 2", "tag 5"])


@query(f"select post_id from memes where post_id not in ({_NAMED})")
def tag_filter_exclude(t):
    return I.tag_filter(t.memes.select("post_id"), t.tags, t.meme_tags, "exclude", ["TAG 2", "tag 5"])


@query("select post_id from memes where post_id not in (select post_id from meme_tags)")
def tag_filter_untagged(t):
    return I.tag_filter(t.memes.select("post_id"), t.tags, t.meme_tags, "untagged")




@query("""select post_id from memes where post_id ilike '%77%' or title ilike '%77%' or subreddit ilike '%77%' or image_url ilike '%77%' or local_image_path ilike '%77%' or permalink ilike '%77%'
  union select post_id from ground_truths where explanation ilike '%77%' or consensus_model ilike '%77%' union select post_id from sources where source_comment_ids ilike '%77%'
  union select post_id from reviews where status ilike '%77%' or reason ilike '%77%' union select post_id from comments where comment_id ilike '%77%' or author ilike '%77%' or body ilike '%77%' or cast(score as varchar) ilike '%77%'
  union select post_id from predictions where model_id ilike '%77%' or prediction ilike '%77%' or error ilike '%77%'
  union select post_id from judgments join predictions p on p.id = prediction_id where model_id ilike '%77%' or judge_model ilike '%77%' or verdict ilike '%77%' or judge_reasoning ilike '%77%' or judge_prompt_version ilike '%77%'
  union select post_id from meme_tags join tags using (tag_id) where name ilike '%77%' or description ilike '%77%' or notes ilike '%77%'
  union select post_id from calls where session_id ilike '%77%' or role ilike '%77%' or model ilike '%77%' or response ilike '%77%' or error ilike '%77%' or verdict ilike '%77%' or reasoning ilike '%77%' or prompt_version ilike '%77%'""")
def full_search(t):
    return I.full_search("77", _searched(t))


def _searched(t):
    predicted = t.predictions.withColumnRenamed("id", "prediction_id")
    return (
        (t.memes, ("post_id", "title", "subreddit", "image_url", "local_image_path", "permalink")),
        (t.ground_truths, ("explanation", "consensus_model")),
        (t.sources, ("source_comment_ids",)),
        (t.reviews, ("status", "reason")),
        (t.comments, ("comment_id", "author", "body", "score")),
        (t.predictions, ("model_id", "prediction", "error")),
        (t.judgments, ("judge_model", "verdict", "judge_reasoning", "judge_prompt_version"), "prediction_id", predicted),
        (t.tags, ("name", "description"), "tag_id", t.meme_tags),
        (t.meme_tags, ("notes",)),
        (t.calls, ("session_id", "role", "model", "response", "error", "verdict", "reasoning", "prompt_version")),
    )


#: A needle with wildcards, in upper case where the texts are not.
NEEDLE = "ABOUT _77%4"


@query(f"""select post_id from memes where title ilike '%{NEEDLE}%' or image_url ilike '%{NEEDLE}%' union select post_id from ground_truths where explanation ilike '%{NEEDLE}%'
  union select post_id from comments where body ilike '%{NEEDLE}%' or author ilike '%{NEEDLE}%'""")
def indexed_search(t):
    """A search by the text index, which is built in two steps: some rows first, under older titles, then all."""
    index = TextIndex(t.spark, scratch_folder(t.spark))
    rows = [
        texts_of("memes", t.memes, "post_id", ("title", "image_url")),
        texts_of("ground_truths", t.ground_truths, "post_id", ("explanation",)),
        texts_of("comments", t.comments, "comment_id", ("body", "author")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    older = F.when(F.col("source") == "memes", F.array(F.lit("about 177 4"), F.get("text", F.lit(1)))).otherwise(F.col("text"))
    index.refresh(every.filter(F.pmod(F.xxhash64("key"), F.lit(3)) > 0).withColumn("text", older))
    index.refresh(every)
    return index.search(NEEDLE)


@query(f"""with st as ({STATE_SQL}), {CLASS} select post_id from st where state = 'validated' and post_id in (select post_id from predictions where error is null) and post_id in (select post_id from cls where verdict_class = 'mixed')
  and post_id in (select post_id from meme_tags) order by case when lower(post_id) = 'p21' then 0 else 1 end, post_id desc limit 3000""")
def inspect_filter(t):
    rows = classify_state(t.memes, t.ground_truths, t.reviews, t.calls).filter("state = 'validated'").select("post_id")
    rows = I.prediction_coverage(rows, t.predictions)
    rows = rows.join(I.verdict_class(t.predictions, t.judgments).filter("verdict_class = 'mixed'"), "post_id", "left_semi")
    return I.inspect_order(I.tag_filter(rows, t.tags, t.meme_tags, "tagged"), "P21")


@query(f"""with st as ({STATE_SQL}), {CLASS}, good as (select id, post_id from predictions where error is null),
  found as (select post_id from memes where title ilike '%3%' or post_id ilike '%3%' union select post_id from ground_truths where explanation ilike '%3%')
  select post_id from st where state = 'validated' and post_id in (select post_id from found) and post_id in (select post_id from good)
  and post_id in (select post_id from good join judgments j on j.prediction_id = good.id) and post_id in (select post_id from cls where verdict_class in ('mixed', 'all_correct'))
  and post_id not in ({_NAMED}) order by post_id desc limit 3000""")
def inspect_all_filters(t):
    """All six filters at once: state, search, both coverages, verdict class and tags."""
    rows = classify_state(t.memes, t.ground_truths, t.reviews, t.calls).filter("state = 'validated'").select("post_id")
    found = I.full_search("3", ((t.memes, ("title", "post_id")), (t.ground_truths, ("explanation",))))
    rows = I.prediction_coverage(rows.join(found, "post_id", "left_semi"), t.predictions)
    rows = I.evaluation_coverage(rows, t.predictions, t.judgments)
    some = I.verdict_class(t.predictions, t.judgments).filter(F.col("verdict_class").isin("mixed", "all_correct"))
    rows = rows.join(some, "post_id", "left_semi")
    return I.inspect_order(I.tag_filter(rows, t.tags, t.meme_tags, "exclude", ["tag 2", "Tag 5"]))


@query("""with l as (select distinct post_id, unnest(from_json(source_comment_ids, '["VARCHAR"]')) as comment_id from sources), c as (select c.*, l.comment_id is not null as src from comments c join sources s using (post_id) left join l on l.post_id = c.post_id and l.comment_id = c.comment_id),
  r as (select post_id, case when src then 'source' else 'other' end as section, row_number() over (partition by post_id, src order by score desc, comment_id) as position, comment_id from c)
  select * from r where section = 'source' or position <= 5""")
def source_vs_other_comments(t):
    return I.source_vs_other_comments(t.sources, t.comments).withColumn("position", F.col("position").cast("long"))


PUBLISHED = f"""{VOTES}, pp as (select post_id, model_id, cv from predictions p left join voted on voted.prediction_id = p.id where error is null)"""


@query(f"""with {PUBLISHED} select m.post_id from memes m join ground_truths g using (post_id) where contains(lower(concat_ws(' ', m.post_id, title, subreddit, explanation)), 'urgent')
  and m.post_id in (select post_id from pp where model_id = 'model_2') and (select list_sort(list(distinct cv)) from pp where pp.post_id = m.post_id and model_id = 'model_2' and cv is not null) = ['correct']""")
def filter_published(t):
    posts = t.memes.join(t.ground_truths.select("post_id", F.col("explanation").alias("ground_truth")), "post_id")
    voted = voted_predictions(t.predictions, t.judgments).select("prediction_id", "consensus_verdict")
    predictions = t.predictions.filter("error is null").withColumnRenamed("id", "prediction_id").join(voted, "prediction_id", "left")
    return I.filter_published(posts, predictions, " Urgent", "model_2", "all_correct")


@query("""with h as (select *, judge_model is not null and id = max(id) over (partition by prediction_id, judge_model) as latest from judgments)
  select p.id as prediction_id, post_id, row_number() over (partition by post_id order by model_id, p.id) as position, coalesce(j, '') as judges, coalesce(historical, 0) as historical from predictions p
  left join (select prediction_id, string_agg(judge_model, ',' order by judge_model) filter (latest) as j, count(*) filter (not latest) as historical from h group by prediction_id) x on x.prediction_id = p.id where error is null""")
def sort_published(t):
    from ..operators.judging import judgment_history

    predictions = t.predictions.filter("error is null").withColumnRenamed("id", "prediction_id")
    return I.sort_published(predictions, judgment_history(t.judgments)).withColumn("position", F.col("position").cast("long"))


# prompts and answers

TOP = "top as (select * from (select post_id, comment_id, author, body, score, row_number() over (partition by post_id order by score desc, comment_id) as rk from comments where score >= 5) where rk <= 10)"


@query(f"with {TOP} select post_id, comment_id, score, rk as rank from top")
def qualifying_comments(t):
    return C.qualifying_comments(t.comments).select("post_id", "comment_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with {TOP}, l as (select post_id, count(*) as n, string_agg('ID: ' || comment_id || ' | Score: ' || score || ' | Author: ' || author || chr(10) || body || chr(10) || '---', chr(10) order by rk, comment_id) as lines from top group by post_id)
  select m.post_id, coalesce(n, 0) as n, coalesce(n, 0) >= 3 as called, case when n >= 3 then 'Subreddit: r/' || subreddit || chr(10) || chr(10) || 'Comments (' || n || ' total):' || chr(10) || lines end as prompt from memes m left join l using (post_id)""")
def consensus_prompts(t):
    return C.consensus_prompts(t.memes, C.qualifying_comments(t.comments))


@query(f"""with {TOP}, l as (select post_id, count(*) as n, string_agg('- (' || score || ') ' || body, chr(10) order by rk, comment_id) as lines from top group by post_id)
  select m.post_id, 'Subreddit: r/' || subreddit || chr(10) || 'Title: ' || title || chr(10) || chr(10) || 'Top comments (' || coalesce(n, 0) || ' total):' || chr(10) || coalesce(lines, '') as prompt from memes m left join l using (post_id)""")
def safety_prompts(t):
    return C.safety_prompts(t.memes, C.qualifying_comments(t.comments))


@query("""with js as (select distinct judge_model from judgments where judge_model is not null) select p.id as prediction_id, js.judge_model, 'Ground Truth Explanation:' || chr(10) || explanation || chr(10) || chr(10) || 'Model''s Explanation:' || chr(10) || prediction as prompt
  from predictions p cross join js join ground_truths g using (post_id) where error is null and post_id in (select post_id from reviews where status = 'validated')
  and not exists (select 1 from judgments j where j.prediction_id = p.id and j.judge_model = js.judge_model)""")
def judge_prompts(t):
    pairs = pending_judgments(t.predictions, t.judgments, few(t.judgments, "judge_model"), t.reviews)
    return C.judge_prompts(pairs, t.predictions, t.ground_truths)


@query("select post_id, substr(sha256('consensus' || subreddit || title), 1, 16) as prompt_id from memes")
def prompt_id(t):
    return t.memes.select("post_id", H.prompt_id(F.lit("consensus"), F.col("subreddit"), F.col("title")).alias("prompt_id"))


#: Answers with every reason to be rejected, by the key.
ANSWERS = """select post_id, n, case when n % 17 = 0 then 'no json' when n % 17 = 1 then '{"reasoning":"r"}' when n % 17 = 2 then '{"reasoning":"r","has_consensus":true,"agreeing_comment_ids":[1,2,3],"confidence":0.9}' else
  '{"reasoning":"r","has_consensus":' || case when n % 5 = 0 then 'false' when n % 5 = 1 then '"true"' else 'true' end || ',"agreeing_comment_ids":["' || lo || '","' || hi || '","' || case when n % 4 = 0 then 'gone' else lo end || case when n % 6 = 0 then '"' else '","' || hi || '"' end
  || '],"selected_explanation":' || case when n % 7 = 0 then 'null' when n % 7 = 1 then '"short"' else '"' || repeat('a long explanation ', 6) || case when n % 7 = 2 then 'It''s JUST so' else '' end || '"' end || ',"confidence":' || case when n % 8 = 0 then '0.5' when n % 8 = 1 then '"0.9"' else '0.75' end || '}' end as response
  from (select post_id, cast(substr(post_id, 2) as bigint) as n, min(comment_id) as lo, max(comment_id) as hi from comments group by post_id) c"""


@query(f"""with a as ({ANSWERS}), s as (select distinct post_id, comment_id, score from comments), w as (select post_id, n, response, case when n % 4 = 0 then 'gone' else lo end as third, lo, hi,
    case when n % 6 = 0 then [lo, hi, case when n % 4 = 0 then 'gone' else lo end] else [lo, hi, case when n % 4 = 0 then 'gone' else lo end, hi] end as ids
    from (select a.*, lo, hi from a join (select post_id, min(comment_id) as lo, max(comment_id) as hi from comments group by post_id) using (post_id))),
  av as (select post_id, avg(score) as av from (select post_id, unnest(ids) as comment_id from w where n % 17 > 2) i join comments c using (post_id, comment_id) group by post_id),
  st as (select w.post_id, ids, case when n % 17 <= 2 then 0 else coalesce(av, 0) end as av, case when n % 17 <= 2 then 'parse_error' when n % 5 = 0 then 'no_consensus' when n % 8 = 0 then 'low_confidence' when n % 7 = 0 then 'no_explanation' when n % 7 = 1 then 'short_explanation'
    when n % 7 = 2 then 'vague_phrase' when coalesce(av, 0) < 5 then 'low_score' when len(ids) < 3 then 'few_agreeing' else 'accepted' end as stage from w left join av using (post_id))
  select post_id, stage, stage = 'accepted' as accepted, case when stage in ('few_agreeing', 'accepted') then len(ids)::int else 0 end as num_agreeing, round(case when stage in ('low_score', 'few_agreeing', 'accepted') then av else 0 end, 6) as avg_score from st""")
def validate_consensus(t):
    t.comments.createOrReplaceTempView("comments")
    return C.validate_consensus(t.spark.sql(ANSWERS).drop("n"), t.comments)


SAFETY = """select id, case id % 6 when 0 then '{"keep": true}' when 1 then '{"keep": false, "category": "slur"}' when 2 then '{"category": "x"}' when 3 then 'no' when 4 then '{"keep": "false"}' else '{"keep": 1, "category": 5}' end as response from calls"""


@query(f"""select id, case id % 6 when 0 then 'keep' when 1 then 'exclude' when 4 then 'exclude' end as verdict, case id % 6 when 0 then 'unspecified' when 1 then 'slur' when 4 then 'unspecified' end as category, id % 6 in (2, 3, 5) as error from ({SAFETY})""")
def parse_safety(t):
    t.calls.createOrReplaceTempView("calls")
    return C.parse_safety(t.spark.sql(SAFETY).withColumnRenamed("id", "post_id")).withColumnRenamed("post_id", "id")


JUDGED = """select id, case id % 7 when 0 then '{"reasoning": "because so", "verdict": "Correct"}' when 1 then 'Sure: {"reasoning": "it differs", "verdict": "incorrect"} done' when 2 then '{"reasonation": "misspelled", "verdict": "correct"}'
  when 3 then '{"reasoning": "ok", "verdict": "correct"}' when 4 then '{"reasoning": "long enough", "": "incorrect"}' when 5 then '{"reasoning": "long enough", "verdict": "maybe"}' else 'nothing' end as response from calls"""


@query(f"""select id, case id % 7 when 0 then 'correct' when 1 then 'incorrect' when 2 then 'correct' when 4 then 'incorrect' end as verdict, case id % 7 when 0 then 'because so' when 1 then 'it differs' when 2 then 'misspelled' when 4 then 'long enough' end as reasoning,
  case id % 7 when 3 then 'reasoning' when 5 then 'verdict' when 6 then 'parse' end as error from ({JUDGED})""")
def parse_verdicts(t):
    t.calls.createOrReplaceTempView("calls")
    return R.parse_verdicts(t.spark.sql(JUDGED)).select("id", "verdict", "reasoning", "error")


OUTPUT = "select post_id, model as model_id, case id % 5 when 0 then '  ' when 1 then null else response end as text, case id % 4 when 0 then 'length' when 1 then 'stop' when 2 then 'max_tokens' end as finish_reason, id from calls"


@query(f"""with o as (select *, case when finish_reason in ('length', 'max_tokens', 'max_output_tokens') then 'truncated' when trim(coalesce(text, '')) = '' then 'empty' end as e from ({OUTPUT})) select post_id, model_id, case when e is null then text end as prediction, e as error from o""")
def validate_predictions(t):
    t.calls.createOrReplaceTempView("calls")
    return R.validate_predictions(t.spark.sql(OUTPUT))


SHAPES = """select id, case id % 5 when 0 then '{"choices":[{"message":{"content":"' || response || '"},"finish_reason":"stop"}],"usage":{"prompt_tokens":' || cast(id as string) || ',"completion_tokens":3}}'
  when 1 then '{"output_text":"' || response || '","stop_reason":"max_tokens","usage":{"input_tokens":7,"output_tokens":' || cast(id as string) || '}}'
  when 2 then '{"choices":[{"message":{"content":[{"text":"a"},{"text":"' || response || '"}]},"finish_details":{"type":"done"}}]}'
  when 3 then '{"output":[{"content":"x"},{"content":[{"text":"' || response || '"}]}]}' else '{"content":"' || response || '","usage":{}}' end as response from calls"""


@query("""select id, case id % 5 when 2 then 'a' || chr(10) || response when 3 then 'x' || chr(10) || response else response end as text, case id % 5 when 0 then 'stop' when 1 then 'max_tokens' when 2 then 'done' end as finish_reason,
  cast(case id % 5 when 0 then id when 1 then 7 else 0 end as bigint) as prompt_tokens, cast(case id % 5 when 0 then 3 when 1 then id else 0 end as bigint) as completion_tokens from calls""")
def flatten_responses(t):
    t.calls.createOrReplaceTempView("calls")
    return R.flatten_responses(t.spark.sql(SHAPES))


# fingerprints and duplicates

DIFF = "list_sum(list_transform(range(0, 63), lambda i: case when embedding[i + 1] > embedding[i + 2] then (1::bigint << (62 - i)::int) else 0 end))::bigint"
MEAN = "list_sum(list_transform(range(0, 63), lambda i: case when embedding[i + 1]::double > list_avg(embedding[1:63]::double[]) then (1::bigint << (62 - i)::int) else 0 end))::bigint"


def _prints(t):
    """63-bit hashes of vectors, as of rasters of one row."""
    e = F.slice("embedding", 1, 64)
    d = H.packed_bits(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.get(e, i) > F.get(e, i + 1)))
    return t.embeddings.select("vec_id", d.alias("dhash"), H.ahash(F.slice("embedding", 1, 63)).alias("ahash"))


@query(f"select vec_id, lower(lpad(printf('%x', {DIFF}), 16, '0')) as dhash, lower(lpad(printf('%x', {MEAN}), 16, '0')) as ahash from embeddings")
def image_hashes(t):
    return _prints(t)


#: Rasters of 9 x 8 values from a vector and the first values of the next one, and their bits in SQL.
RASTER = "raster as (select a.vec_id, list_concat(a.embedding[1:64], b.embedding[1:8]) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
RASTER_DIFF = "list_sum([case when v[i + i // 8 + 1] > v[i + i // 8 + 2] then 1::hugeint << (63 - i)::int else 0::hugeint end for i in range(64)])"
RASTER_MEAN = "list_sum([case when v[i + 1]::double > list_sum(v[1:64]::double[]) / 64 then 1::hugeint << (63 - i)::int else 0::hugeint end for i in range(64)])"


@query(f"with {RASTER} select vec_id, lower(lpad(to_hex({RASTER_DIFF}::uhugeint), 16, '0')) as dhash, lower(lpad(to_hex({RASTER_MEAN}::uhugeint), 16, '0')) as ahash from raster")
def raster_hashes(t):
    """Both hashes of rasters: of 9 x 8 values for the differences, of its first 64 for the mean."""
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", 1, 8).alias("more"))
    raster = t.embeddings.join(following, "vec_id").select("vec_id", F.concat(F.slice("embedding", 1, 64), "more").alias("v"))
    return raster.select("vec_id", H.dhash(F.col("v")).alias("dhash"), H.ahash(F.slice("v", 1, 64)).alias("ahash"))


@query("select doc_id, sha256(coalesce(text, '')) as exact_hash from documents")
def exact_hash(t):
    return t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("exact_hash"))


@query(f"with h as (select vec_id, {DIFF} as d, {MEAN} as a from embeddings) select vec_id, bit_count(xor(d, a))::int as distance from h")
def hamming(t):
    return _prints(t).select("vec_id", H.hamming(F.col("dhash"), F.col("ahash")).alias("distance"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey > 0 and l_quantity > 0 and l_partkey > 0 and abs(l_linenumber::double / nullif(l_quantity, 0) - l_suppkey::double / nullif(l_partkey, 0)) <= 0.02 as aspect_close from lineitem where l_partkey > 0")
def aspect_close(t):
    c = F.col
    return t.lineitem.filter("l_partkey > 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", H.aspect_close(c("l_linenumber"), c("l_quantity"), c("l_suppkey"), c("l_partkey")).alias("aspect_close"))


_FLIPS = (0, 7, 255, 255, 8191)


def _fingerprints(t):
    """Pending and reviewed fingerprints, stored as a pipeline has them. Reviewed: even vectors; pending: all, with planted
    differences by class."""
    rows = _prints(t)
    flip = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in _FLIPS)), (F.col("vec_id") % 5 + 1).cast("int"))
    hexa = lambda bits: F.lower(F.lpad(F.hex(bits), 16, "0"))
    shape = {"width": F.lit(100), "height": F.lit(100)}
    reviewed = rows.filter("vec_id % 2 = 0").withColumns({"post_id": F.concat(F.lit("r"), F.col("vec_id")), "exact_hash": F.concat(F.lit("r"), F.col("vec_id")), **shape})
    pending = rows.withColumns(
        {
            "post_id": F.concat(F.lit("q"), F.col("vec_id")),
            "exact_hash": F.when(F.col("vec_id") % 20 == 0, F.concat(F.lit("r"), F.col("vec_id"))).otherwise(F.concat(F.lit("q"), F.col("vec_id"))),
            "dhash": hexa(H.as_bits(F.col("dhash")).bitwiseXOR(flip)),
            "ahash": hexa(H.as_bits(F.col("ahash")).bitwiseXOR(F.when(F.col("vec_id") % 5 == 3, 7).otherwise(0).cast("bigint"))),
            **shape,
        }
    )
    return D.written(pending), D.written(reviewed)


PAIRS = f"""h as (select vec_id, {DIFF} as d, {MEAN} as a from embeddings), q as (select 'q' || vec_id as q, vec_id as qv, xor(d, [0, 7, 255, 255, 8191][vec_id % 5 + 1]::bigint) as d, xor(a, case when vec_id % 5 = 3 then 7 else 0 end::bigint) as a from h),
r as (select 'r' || vec_id as r, vec_id as rv, d, a from h where vec_id % 2 = 0),
pairs as (select q as pending_id, r as reviewed_id, qv = rv and qv % 20 = 0 as exact, case when qv = rv and qv % 20 = 0 then 0 else bit_count(xor(q.d, r.d)) end::int as dh, case when qv = rv and qv % 20 = 0 then 0 else bit_count(xor(q.a, r.a)) end::int as ah
  from q join r on (qv = rv and qv % 20 = 0) or bit_count(xor(q.d, r.d)) <= 4 or (bit_count(xor(q.d, r.d)) <= 8 and bit_count(xor(q.a, r.a)) <= 2)),
best as (select pending_id, arg_min(reviewed_id, (not exact, dh + ah, reviewed_id)) as reviewed_id, arg_min(exact, (not exact, dh + ah, reviewed_id)) as exact, arg_min(dh, (not exact, dh + ah, reviewed_id)) as dh, arg_min(ah, (not exact, dh + ah, reviewed_id)) as ah from pairs group by pending_id)"""


@query(f"with {PAIRS} select pending_id, reviewed_id, exact, dh, ah from pairs where not exact")
def candidate_duplicates(t):
    """All pairs but the exact ones, of which each pending post has one at most."""
    found = D.candidate_pairs(*_fingerprints(t)).groupBy("pending_id", "reviewed_id").agg(F.max("exact").alias("exact"), F.max("dh").alias("dh"), F.max("ah").alias("ah"))
    return found.filter("not exact")


#: Bits by which the rasters of pending images are changed, by class.
_SHIFTS = (0, 2, 8)


def _rasters(t):
    """Rasters of 21 RGB pixels from vectors; those of pending images are changed a little or too much."""
    value = lambda x: F.pmod((x.cast("double") * 100).cast("bigint"), F.lit(256))
    shift = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in _SHIFTS)), (F.col("vec_id") % 3 + 1).cast("int"))
    raster = lambda of: F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(of(value(x))), 2, "0")), ""))
    pending = t.embeddings.select(F.concat(F.lit("q"), "vec_id").alias("post_id"), raster(lambda v: v.bitwiseXOR(shift)).alias("raster"))
    return D.written(pending.unionByName(t.embeddings.select(F.concat(F.lit("r"), "vec_id").alias("post_id"), raster(lambda v: v).alias("raster"))))


PIXELS = """e as (select vec_id, list_transform(range(1, 64), lambda i: ((trunc(embedding[i]::double * 100)::bigint % 256) + 256) % 256) as p from embeddings),
s as (select vec_id, list_transform(p, lambda x: xor(x, [0, 2, 8][vec_id % 3 + 1]::bigint)) as p from e),
diffs as (select pairs.*, case when exact then 0.0 else list_avg(list_transform(range(0, 21), lambda i: (19595 * abs(s.p[3 * i + 1] - e.p[3 * i + 1]) + 38470 * abs(s.p[3 * i + 2] - e.p[3 * i + 2]) + 7471 * abs(s.p[3 * i + 3] - e.p[3 * i + 3]) + 32768) >> 16)) end::double as diff
  from pairs join s on pending_id = 'q' || s.vec_id join e on reviewed_id = 'r' || e.vec_id),
checked as (select pending_id, arg_min(reviewed_id, (not exact, dh + ah, reviewed_id)) as reviewed_id, arg_min(exact, (not exact, dh + ah, reviewed_id)) as exact, arg_min(dh, (not exact, dh + ah, reviewed_id)) as dh, arg_min(ah, (not exact, dh + ah, reviewed_id)) as ah
  from diffs where diff <= 4.0 group by pending_id)"""


@query(f"with {PAIRS}, {PIXELS} select pending_id, reviewed_id, dh, ah, diff from diffs where not exact")
def pixel_difference(t):
    """The pixel difference of all pairs that match by their hashes."""
    prints = _fingerprints(t)
    pairs = D.near_pairs(*prints)
    exact = D.exact_pairs(*prints).select("pending_id", "reviewed_id")
    pairs = D.written(pairs.join(exact, ["pending_id", "reviewed_id"], "left_anti"))
    return D.pixel_differences(pairs, _rasters(t)).drop("exact")


@query(f"with {PAIRS}, {PIXELS} select pending_id, reviewed_id, exact, dh, ah from checked")
def near_duplicate_images(t):
    return D.near_duplicates(*_fingerprints(t), _rasters(t))


@query(f"with {PAIRS}, {PIXELS} select pending_id as post_id, 'excluded' as status, 'duplicate_image:' || reviewed_id as reason from checked")
def exclude_duplicates(t):
    return D.exclusions(D.near_duplicates(*_fingerprints(t), _rasters(t)))


@query("select post_id, local_image_path from memes where local_image_path is not null and post_id not in (select post_id from batch_memes where stage_status = 'judged')")
def fingerprint_backfill(t):
    return D.fingerprint_backfill(t.memes, t.batch_memes.filter("stage_status = 'judged'").select("post_id"))


# snapshots and exports

SNAP = "m0 as (select * from snapshot_memes where snapshot_id = 'snap_0')"


def _members(t):
    return t.snapshot_memes.filter("snapshot_id = 'snap_0'")


@query("select substr(sha256(coalesce(string_agg(post_id || explanation, '' order by post_id), '')), 1, 16) as dataset_version from ground_truths where post_id in (select post_id from reviews where status = 'validated')")
def dataset_version(t):
    return X.dataset_version(X.curated_pairs(t.ground_truths, t.reviews))


@query("""with p as (select post_id, explanation from ground_truths where post_id in (select post_id from reviews where status = 'validated')), v as (select substr(sha256(string_agg(post_id || explanation, '' order by post_id)), 1, 16) as dataset_version, count(*) as posts from p)
  select 'v_' || dataset_version as snapshot_id, dataset_version, posts from v where posts > 0""")
def create_snapshot(t):
    old = t.snapshot_memes.select(F.col("snapshot_id").alias("dataset_version")).distinct()
    return X.create_snapshot(X.curated_pairs(t.ground_truths, t.reviews), old)


TREE = """p as (select post_id, coalesce(explanation, '') as explanation from ground_truths where post_id in (select post_id from reviews where status = 'validated')),
  leaves as (select substr(sha256(post_id), 1, 4) as leaf, sha256(string_agg(d, '' order by d)) as d from (select post_id, sha256(post_id || chr(31) || sha256(explanation)) as d from p) group by all),
  nodes as (select substr(leaf, 1, 2) as node, sha256(string_agg(leaf || d, '' order by leaf || d)) as d from leaves group by all),
  tree as (select substr(sha256(coalesce(string_agg(node || d, '' order by node || d), '')), 1, 16) as dataset_version from nodes)"""


@query(f"with {TREE} select dataset_version from tree")
def tree_version(t):
    return X.tree_version(X.curated_pairs(t.ground_truths, t.reviews))


@query(f"with {TREE} select 'v_' || dataset_version as snapshot_id, dataset_version, (select count(*) from p) as posts from tree where (select count(*) from p) > 0")
def create_tree_snapshot(t):
    old = t.snapshot_memes.select(F.col("snapshot_id").alias("dataset_version")).distinct()
    return X.create_snapshot(X.curated_pairs(t.ground_truths, t.reviews), old, X.tree_version)


@query("select batch_id as snapshot_id from (select batch_id, max(position) as created_at from batch_memes group by batch_id) where starts_with(batch_id, 'b1') order by batch_id <> 'b1', created_at desc, batch_id limit 1")
def find_snapshot(t):
    listed = t.batch_memes.groupBy(F.col("batch_id").alias("snapshot_id")).agg(F.max("position").alias("created_at"))
    return X.find_snapshot(listed, "b1")


@query("select post_id, status from regressions order by annotated_at desc, post_id desc limit 25")
def newest_regressions(t):
    return X.newest_first(t.regressions, "annotated_at", "post_id", 25).select("post_id", "status")


@query("select batch_id as snapshot_id, created_at, posts from (select batch_id, max(position) as created_at, count(*) as posts from batch_memes group by batch_id) order by created_at desc, batch_id desc")
def list_snapshots(t):
    listed = t.batch_memes.groupBy(F.col("batch_id").alias("snapshot_id")).agg(F.max("position").alias("created_at"), F.count("*").alias("posts"))
    return X.newest_first(listed, "created_at", "snapshot_id")


@query("select run_id, run_order, n, passed from (select run_id, run_order, count(*) as n, count(*) filter (passed) as passed from eval_results group by run_id, run_order) order by run_order desc limit 5")
def newest_eval_runs(t):
    runs = t.eval_results.groupBy("run_id", "run_order").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    return X.newest_first(runs, "run_order", "run_id", 5)


@query("select post_id, gate, gate_decision, correct_decision from feedback where gate = 'safety' order by created_at desc, post_id desc limit 25")
def newest_feedback(t):
    rows = X.newest_first(t.feedback.filter("gate = 'safety'"), "created_at", "post_id", 25)
    return rows.select("post_id", "gate", "gate_decision", "correct_decision")


_MEMES = f"{SNAP}, em as (select snapshot_id, post_id, title, subreddit, explanation as ground_truth, post_id || '.' || case when local_image_path is null then 'jpg' else lower(regexp_extract(local_image_path, '\\.([A-Za-z0-9]+)$', 1)) end as image from m0 join memes using (post_id) join ground_truths using (post_id))"


@query(f"with {_MEMES} select * from em")
def export_memes(t):
    return X.export_memes(_members(t), t.memes, t.ground_truths)


PROMPT = """pv as (select post_id, model as model_id, response as prediction, arg_max(prompt_version, id) as prompt_version from calls where role = 'predictor' and error is null and response is not null group by all)"""


@query(f"with {PROMPT} select p.id, p.post_id, p.model_id, prompt_version from predictions p left join pv on pv.post_id = p.post_id and pv.model_id = p.model_id and pv.prediction = p.prediction")
def prediction_prompt(t):
    return X.prediction_prompt(t.predictions, t.calls).select("id", "post_id", "model_id", "prompt_version")


@query(f"""with {SNAP}, {VOTES}, {PROMPT} select p.id as prediction_id, p.post_id, p.model_id, p.prediction, prompt_version, coalesce(judges, 0) as judges, coalesce(c, 0) as correct_votes, coalesce(i, 0) as incorrect_votes, cv as consensus_verdict
  from predictions p left join voted on voted.prediction_id = p.id left join pv on pv.post_id = p.post_id and pv.model_id = p.model_id and pv.prediction = p.prediction where error is null and p.post_id in (select post_id from m0)""")
def export_predictions(t):
    return X.export_predictions(_members(t), t.predictions, t.judgments, t.calls)


@query(f"""with {SNAP} select j.id as judgment_id, prediction_id, post_id, model_id, coalesce(judge_model, '(unknown)') as judge_model, verdict, judge_prompt_version, judge_model is not null and j.id = max(j.id) over (partition by prediction_id, judge_model) as is_latest
  from judgments j join predictions p on p.id = prediction_id where error is null and post_id in (select post_id from m0)""")
def export_judgments(t):
    return X.export_judgments(_members(t), t.predictions, t.judgments)


_SCOPED = COUNTS.format(scope="and post_id in (select post_id from m0)", also="where post_id in (select post_id from m0)")


EXPORTED_BOARD = f"with {SNAP}, {VOTES}, {_SCOPED} {BOARD}"


@query(EXPORTED_BOARD)
def export_leaderboard(t):
    return X.export_leaderboard(_members(t), t.predictions, t.judgments).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_MEMES} select 'snap_0' as snapshot_id, 'memes' as table_name, count(*) as n from em union all select 'snap_0', 'predictions', count(*) from predictions where error is null and post_id in (select post_id from m0)")
def dataset_info(t):
    members = _members(t)
    return X.dataset_info("snap_0", memes=X.export_memes(members, t.memes, t.ground_truths), predictions=X.export_predictions(members, t.predictions, t.judgments, t.calls))


@query("select s.snapshot_id, count(distinct s.post_id) as posts, count(distinct model_id) as models from snapshot_memes s left join predictions p on p.post_id = s.post_id and error is null group by 1")
def push_log(t):
    return X.push_log(t.snapshot_memes, t.predictions)


@query("""select g.post_id, title, subreddit, explanation, coalesce(consensus_confidence, 0) as confidence, coalesce(num_agreeing_comments, 0) as num_agreeing, case when source_comment_ids is null then 0 else 3 end as n_sources,
  coalesce(array_to_string(from_json(source_comment_ids, '["VARCHAR"]'), ','), '') as source_ids from ground_truths g join memes using (post_id) left join sources using (post_id) where g.post_id in (select post_id from reviews where status = 'validated')""")
def curated_records(t):
    return X.curated_records(X.curated_pairs(t.ground_truths, t.reviews), t.ground_truths, t.sources, t.memes)


@query("select m.post_id, coalesce(string_agg(comment_id || ':' || score, ',' order by score desc, comment_id, author, body), '') as comments from memes m left join comments c using (post_id) group by m.post_id")
def reconstruct_posts(t):
    rows = X.reconstruct_posts(t.memes.select("post_id"), t.comments)
    return rows.select("post_id", F.array_join(F.transform("comments", lambda c: F.concat(c["comment_id"], F.lit(":"), c["score"].cast("string"))), ",").alias("comments"))


@query("select r.post_id, case when coalesce(trim(explanation) = trim(coalesce(consensus_at_annotation, '')), false) then 'unchanged' else 'changed' end as outcome from regressions r left join ground_truths using (post_id)")
def regression_diff(t):
    return X.regression_diff(t.regressions, t.ground_truths)


@query("select post_id, status, case when length(trim(consensus_at_annotation)) > 220 then substr(trim(consensus_at_annotation), 1, 220) || '…' else trim(consensus_at_annotation) end as consensus, coalesce(canonical_explanation, '—') as canonical, coalesce(failure_modes, '—') as failure_modes, substr(cast(annotated_at as varchar), 1, 10) as date from regressions")
def regression_listing(t):
    return X.regression_listing(t.regressions)


@query("select post_id, gate, coalesce(gate_decision, '—') as gate_decision, coalesce(correct_decision, '—') as correct_decision, case when length(replace(notes, chr(10), ' ')) > 12 then substr(replace(notes, chr(10), ' '), 1, 12) || '…' else replace(notes, chr(10), ' ') end as notes from feedback")
def truncate_listing(t):
    return X.feedback_listing(t.feedback, 12)


# audits


@query("""with v as (select * from reviews where status = 'validated') select 'validated_count' as check_name, abs(count(*) - 3000)::bigint as bad from v union all select 'missing_ground_truth', count(*) from v where post_id not in (select post_id from ground_truths where trim(explanation) <> '')
  union all select 'duplicate_reason', count(*) from v where reason ilike '%duplicate%' union all select 'missing_image', count(*) from memes where post_id in (select post_id from v) and coalesce(local_image_path, '') = ''""")
def audit_tables(t):
    return A.audit_tables(t.memes, t.ground_truths, t.reviews, 3000)


@query("""with s as (select post_id, case when post_id like '%7' then 'oops' else source_comment_ids end as ids from sources) select post_id, 'not an array of strings' as problem from s where ids = 'oops' union all
  select distinct post_id, 'unknown comment' from (select post_id, unnest(from_json(ids, '["VARCHAR"]')) as comment_id from s where ids <> 'oops') i where not exists (select 1 from comments c where c.post_id = i.post_id and c.comment_id = i.comment_id)""")
def audit_source_ids(t):
    broken = t.sources.withColumn("source_comment_ids", F.expr("case when post_id like '%7' then 'oops' else source_comment_ids end"))
    return A.audit_source_ids(broken, t.comments)


@query("select 'author' as key, count(*) filter (id % 3 = 0) as n from calls union all select 'prompt', count(*) filter (id % 2 = 0) from calls")
def audit_export_keys(t):
    value = "case when id % 6 = 0 then '{\"a\":[{\"author\":1}],\"prompt\":2}' when id % 3 = 0 then '{\"b\":{\"author\":null}}' when id % 2 = 0 then '{\"prompt\":\"x\"}' else '{\"title\":\"author\"}' end"
    return A.audit_export_keys(t.calls.select(F.expr(value).alias("value")))


@query(f"""with {SNAP}, ep as (select id, post_id from predictions where error is null and post_id in (select post_id from m0)) select 'post_count' as check_name, abs(count(*) - 1000)::bigint as bad from m0 union all
  select 'image_count', abs(count(*) - (select count(*) from memes where local_image_path is not null and post_id in (select post_id from m0)))::bigint from m0 union all select 'prediction_posts', count(*) from predictions where error is null and post_id not in (select post_id from m0) union all
  select 'null_prediction_ids', 0 union all select 'judgment_predictions', count(*) from judgments where prediction_id not in (select id from predictions where error is null)""")
def audit_export_fk(t):
    members = _members(t)
    predictions = t.predictions.filter("error is null").withColumnRenamed("id", "prediction_id")
    images = t.memes.filter("local_image_path is not null").join(members, "post_id", "left_semi")
    return A.audit_export_fk(members, predictions, t.judgments, images, 1000)


# tags


@query("select tag_id, name, count(post_id) as posts from tags left join meme_tags using (tag_id) group by all")
def tag_summaries(t):
    return G.tag_summaries(t.tags, t.meme_tags)


@query("select post_id, string_agg(name || ':' || coalesce(notes, ''), '|' order by lower(name), name) as tags from meme_tags join tags using (tag_id) group by post_id")
def tags_per_post(t):
    return G.tags_per_post(t.tags, t.meme_tags)


@query("""with n as (select '  ' || case when l_partkey % 2 = 0 then 'Tag' else 'TAG' end || '   ' || l_partkey % 13 || ' ' as name, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as position from lineitem), c as (select regexp_replace(trim(name), '\\s+', ' ', 'g') as name, position from n)
  select arg_min(name, (position, name)) as name, min(position) as position from c group by lower(name)""")
def clean_tag_names(t):
    rows = t.lineitem.selectExpr("'  ' || case when l_partkey % 2 = 0 then 'Tag' else 'TAG' end || '   ' || cast(l_partkey % 13 as string) || ' ' as name", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as position")
    return G.clean_tag_names(rows)


@query("select tag_id, name from tags where lower(name) = 'tag 5'")
def tag_by_name(t):
    return G.tag_by_name(t.tags, " TAG  5 ").select("tag_id", "name")


@query("select post_id, tag_id from meme_tags where tag_id not in (3, 4)")
def remove_tag(t):
    return G.remove_tag(t.tags, t.meme_tags, t.tags.filter("tag_id in (3, 4)"))[1].select("post_id", "tag_id")


@query("""select tag_id, case when tag_id in (1, 5) then 'renamed ' || tag_id else name end as name, case when tag_id in (1, 5) then 'renamed' when tag_id = 2 then 'conflict' when tag_id = 3 then 'empty' else 'kept' end as outcome from tags""")
def rename_tag(t):
    renames = t.tags.filter("tag_id in (1, 2, 3, 5)").selectExpr("tag_id", "case tag_id when 2 then 'TAG  4' when 3 then '  ' else ' renamed  ' || cast(tag_id as string) end as new_name")
    return G.rename_tags(t.tags, renames).select("tag_id", "name", "outcome")


# the evaluation set


@query("""with u as (select post_id, case when status in ('wrong', 'partial') then 'bad_gloss' else 'hard_yes_consensus' end as category, true as expected_has_consensus, coalesce(canonical_explanation, consensus_at_annotation) as expected_explanation, 'consensus_regression' as source, coalesce(failure_modes, reviewer_notes) as notes, 0 as rk from regressions
  union all select post_id, case when d like '%no%' and d like '%consensus%' then 'false_positive_consensus' when d like '%consensus%' or coalesce(gate_decision, '') like '%no_consensus%' then 'hard_yes_consensus' else 'bad_gloss' end, not (d like '%no%' and d like '%consensus%'), null, 'gate_feedback', notes, 1
  from (select *, lower(coalesce(correct_decision, '')) as d from feedback where gate = 'consensus')), k as (select *, row_number() over (partition by post_id order by rk desc) as rn from u)
  select post_id, category, expected_has_consensus, expected_explanation, source, notes from k where rn = 1""")
def seed_from_flags(t):
    return E.seed_from_flags(t.regressions, t.feedback)


@query("""select post_id from ground_truths where post_id in (select post_id from reviews where status = 'validated') and post_id not in (select post_id from eval_items) order by sha256('yes' || post_id) limit 50""")
def sample_yes_controls(t):
    return E.sample_yes_controls(t.reviews, t.ground_truths, t.eval_items, 50, "yes")


@query("""select post_id from (select distinct post_id from states where stage = 'consensus' and status = 'no_consensus') where post_id not in (select post_id from ground_truths) and post_id not in (select post_id from reviews where status = 'excluded')
  and post_id not in (select post_id from eval_items) order by sha256('no' || post_id) limit 50""")
def sample_no_controls(t):
    return E.sample_no_controls(t.states, t.reviews, t.ground_truths, t.eval_items, 50, "no")


@query("select category, count(*) as n from eval_items where active group by rollup (category)")
def eval_category_counts(t):
    return E.eval_category_counts(t.eval_items)


@query("""select run_id, category, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (expected_has_consensus) as expected_yes, count(*) filter (not expected_has_consensus) as expected_no,
  count(*) filter (not expected_has_consensus and actual_has_consensus) as false_positive, count(*) filter (expected_has_consensus and not actual_has_consensus) as false_negative, round(count(*) filter (passed)::double / count(*), 6) as accuracy
  from eval_results group by grouping sets ((run_id, category), (run_id))""")
def eval_report(t):
    return E.eval_report(t.eval_results)


@query("select * from (select post_id, row_number() over (partition by post_id order by run_order desc) as position, run_id, passed from eval_results) where position <= 5")
def recent_results_per_item(t):
    return E.recent_results_per_item(t.eval_results).withColumn("position", F.col("position").cast("long"))


@query("select arg_max(run_id, run_order) as run_id from eval_results")
def latest_eval_run(t):
    return E.latest_eval_run(t.eval_results)


@query("select post_id, title, category, case when expected_has_consensus then 'consensus' else 'no consensus' end as expected from eval_items join memes using (post_id) where active and category = 'bad_gloss' and (title ilike '%high%' or post_id ilike '%high%') order by category, updated_at desc, post_id limit 100")
def eval_item_filter(t):
    return E.eval_item_filter(t.eval_items, t.memes, "bad_gloss", "high", 100)


_ACTIONS = """select post_id, case n % 5 when 0 then 'confirm' when 1 then 'consensus' when 2 then 'no_consensus' when 3 then 'deactivate' end as action, case when n % 2 = 0 then ' better ' else '' end as explanation, case when n % 3 = 0 then 'seen' end as reviewer_notes, '2024-01-01' as noted_at
  from (select post_id, cast(substr(post_id, 2) as bigint) as n from eval_items) i where n % 5 <> 4"""


@query(f"""with a as ({_ACTIONS}) select post_id, case action when 'consensus' then 'hard_yes_consensus' when 'no_consensus' then 'true_no_consensus' else category end as category,
  case action when 'consensus' then true when 'no_consensus' then false else expected_has_consensus end as expected_has_consensus,
  case when action = 'no_consensus' then null when action in ('consensus', 'confirm') then coalesce(nullif(trim(explanation), ''), expected_explanation) else expected_explanation end as expected_explanation,
  case when action is null then notes else concat_ws(chr(10), nullif(trim(coalesce(notes, '')), ''), noted_at || ' eval_review: ' || action || case when coalesce(trim(reviewer_notes), '') <> '' then ' - ' || trim(reviewer_notes) else '' end) end as notes,
  case when action in ('consensus', 'no_consensus') then true when action = 'deactivate' then false else active end as active from eval_items left join a using (post_id)""")
def relabel_eval_items(t):
    t.eval_items.createOrReplaceTempView("eval_items")
    return E.relabel_eval_items(t.eval_items, t.spark.sql(_ACTIONS))


