"""Queries on the vote log: last vote, sentinels, medians, ordinals, labels."""

from __future__ import annotations


from estimark.operators import votes as V
from estimark.plans.registry import register
from estimark.session import materialize
from estimark.sources import bindings as B
from estimark.sources.tables import TEST_TABLES, scan_tables


def latest(spark, sf):
    return V.latest_vote(B.b_vote_log(spark, sf))


@register("scan_tables", sql="\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TEST_TABLES))
def q_scan_tables(spark, sf):
    return scan_tables(spark, sf)


@register("latest_vote", ["latest_votes"], "select * from latest_votes")
def q_latest_vote(spark, sf):
    return latest(spark, sf)


@register("not_in_dictionary", ["latest_votes", "b_dictionary"],
          "select * from latest_votes where score not in (select score from b_dictionary)")
def q_not_in_dictionary(spark, sf):
    return V.not_in_dictionary(latest(spark, sf), B.b_dictionary(spark))


TASK_MEDIAN_SQL = """select room_id, task_id,
  cast(quantile_cont(case when score not in (select score from b_dictionary) then score end, 0.5) as decimal(9,2)) median
from latest_votes group by room_id, task_id"""


@register("task_median", ["latest_votes", "b_dictionary"], TASK_MEDIAN_SQL)
def q_task_median(spark, sf):
    return V.task_median(latest(spark, sf), B.b_dictionary(spark))


@register("median_window", ["latest_votes", "b_dictionary"], """select room_id, task_id, person_id, score,
  cast(quantile_cont(score, 0.5) over (partition by task_id) as decimal(9,2)) median
from latest_votes where score not in (select score from b_dictionary)""")
def q_median_window(spark, sf):
    return V.median_window(latest(spark, sf), B.b_dictionary(spark))


@register("vote_ordinals", ["latest_votes"], """select room_id, task_id, person_id, score,
  cast(row_number() over (partition by task_id order by person_id) as int) person_ord from latest_votes""")
def q_vote_ordinals(spark, sf):
    return V.vote_ordinals(materialize(latest(spark, sf)))


@register("decode_scores", ["latest_votes", "b_dictionary"], """select v.room_id, v.task_id, v.person_id, v.score,
  coalesce(d.meaning, cast(v.score as varchar)) label, coalesce(v.score in (1, 2, 3, 5, 8, 13, 20, 40, 999, 777), false) in_deck
from latest_votes v left join b_dictionary d on v.score = d.score""")
def q_decode_scores(spark, sf):
    return V.decode_scores(latest(spark, sf), B.b_dictionary(spark))


@register("voted_flags", ["b_vote_log"], """select room_id, task_id, count(*) n_persons, count(*) filter (where voted) n_voted
from (select room_id, task_id, person_id, bool_or(score <> 0) voted from b_vote_log group by all) group by all""")
def q_voted_flags(spark, sf):
    return V.voted_flags(B.b_vote_log(spark, sf))


@register("results_by_person", ["latest_votes", "b_persons"], """select v.room_id, v.task_id, v.person_id, p.login_name, v.score
from latest_votes v join b_persons p on v.person_id = p.person_id""")
def q_results_by_person(spark, sf):
    return V.results_by_person(latest(spark, sf), B.b_persons(spark, sf))


@register("score_dictionary", ["latest_votes", "b_dictionary"], """select d.score, d.meaning,
  (select count(*) from latest_votes v where v.score = d.score) n_votes from b_dictionary d""")
def q_score_dictionary(spark, sf):
    return V.dictionary_usage(latest(spark, sf), B.b_dictionary(spark))
