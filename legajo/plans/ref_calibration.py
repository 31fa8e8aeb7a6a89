"""Queries over labelled scores. The labels are languages, regional variants too: English documents against Spanish ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators import calibration as ca, ranks
from legajo.plans.corpus import Registry
from legajo.session import table

R = Registry()


def _scores(s, d):
    """Documents of two languages with a score: the mean word length to two places (which has ties)."""
    lang = F.regexp_extract(F.lower("lang"), "^([a-z]+)(?:[-_]|$)", 1)
    t = table(s, d, "documents").where(lang.isin("es", "en")).select(
        "doc_id", "source", (lang == "en").cast("int").alias("y"), F.substring("published_on", 1, 4).alias("year"), F.size(tx.word_list(F.col("text"))).alias("n"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{L}", ""))).alias("letters"),
    )
    return t.where("n > 0").select("doc_id", "source", "y", "year", F.round(F.col("letters") / F.col("n"), 2).alias("score"))


_S = r"""sc as (select doc_id, source, (regexp_extract(lower(lang), '^([a-z]+)([-_]|$)', 1) = 'en')::int as y, substr(published_on, 1, 4) as year,
 round((length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) / len(regexp_extract_all(text, '\p{L}+')), 2) as score
 from documents where regexp_extract(lower(lang), '^([a-z]+)([-_]|$)', 1) in ('es', 'en') and len(regexp_extract_all(text, '\p{L}+')) > 0)"""
_RANKED = f"{_S}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from sc)"
_AUC = "round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6)"

R.add("average_ranks", lambda s, d: ranks.average_ranks(_scores(s, d), "score").select("doc_id", "avg_rank"), f"with {_RANKED} select doc_id, rk as avg_rank from r")
R.add(
    "auc",
    lambda s, d: ranks.auc(_scores(s, d), "y", "score").select("n_pos", "n_neg", F.round("auc", 6).alias("auc")),
    f"with {_RANKED} select count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg, {_AUC} as auc from r",
)
R.add(
    "roc_points",
    lambda s, d: ranks.roc_points(_scores(s, d), "y", "score"),
    f"""with {_S}, c as (select score, sum(y) as p, sum(1 - y) as q from sc group by 1)
select score as threshold, sum(p) over (order by score desc)::bigint as tp, sum(q) over (order by score desc)::bigint as fp from c""",
)
R.add(
    "sliced_auc",
    lambda s, d: ca.sliced_auc(_scores(s, d), "y", "score", {"year": F.col("year"), "source": F.col("source")}).select("slice", "n_pos", "n_neg", F.round("auc", 6).alias("auc")),
    f"""with {_S}, x as (select 'all' as slice, y, score from sc union all select 'year=' || year, y, score from sc where year is not null union all select 'source=' || source, y, score from sc where source is not null),
r as (select *, rank() over (partition by slice order by score) + (count(*) over (partition by slice, score) - 1) / 2 as rk from x)
select slice, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg, {_AUC} as auc from r group by 1 having count(*) filter (y = 1) >= 5 and count(*) filter (y = 0) >= 5""",
)
_FOLDS = f"""{_S}, g as (select y, source, (row_number() over (partition by y order by source) - 1) % 5 as fold from (select distinct y, source from sc where source is not null)),
f as (select sc.*, fold from sc join g using (y, source)), th as (select k as fold, quantile_cont(score, 0.95) as threshold from f, (select unnest(range(5)) as k) where y = 0 and fold <> k group by k)"""


def _folded(s, d):
    return ca.folds(_scores(s, d), "source", "y")


R.add(
    "fold_thresholds",
    lambda s, d: ca.fold_thresholds(_folded(s, d), "y", "score").select(F.col("fold").cast("bigint").alias("fold"), F.round("threshold", 6).alias("threshold")),
    f"with {_FOLDS} select fold, round(threshold, 6) as threshold from th",
)
R.add(
    "held_out_counts",
    lambda s, d: ca.held_out_counts(_folded(s, d), ca.fold_thresholds(_folded(s, d), "y", "score"), "y", "score"),
    f"""with {_FOLDS} select count(*) filter (score > threshold and y = 1) as tp, count(*) filter (score > threshold and y = 0) as fp,
 count(*) filter (score <= threshold and y = 0) as tn, count(*) filter (score <= threshold and y = 1) as fn from f join th using (fold)""",
)
R.add(
    "applied_threshold",
    lambda s, d: ca.applied(_scores(s, d).where("y = 0"), "score", 5.5, "preliminary", "source"),
    f"with {_S} select source, count(*) as n, count(*) filter (score > 5.5) as n_above, grouping(source)::int as is_total from sc where y = 0 group by rollup (source)",
)
R.add(
    "score_quantiles",
    lambda s, d: _scores(s, d).groupBy("y").agg(*[F.round(F.percentile("score", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)]),
    f"with {_S} select y, round(quantile_cont(score, 0.05), 6) as q5, round(quantile_cont(score, 0.5), 6) as q50, round(quantile_cont(score, 0.95), 6) as q95 from sc group by 1",
)
R.add("bootstrap_auc", lambda s, d: ca.bootstrap_auc(_scores(s, d), "y", "score", "source"))


def _gate(s, d):
    """Whether the score may be used: its interval, its held-out errors and the size of its classes, as one row."""
    scores = _scores(s, d)
    area = ca.bootstrap_auc(scores, "y", "score", "source").select(F.col("low").alias("auc_low"))
    folded = _folded(s, d)
    held = ca.held_out_counts(folded, ca.fold_thresholds(folded, "y", "score"), "y", "score").select((F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))
    sizes = scores.agg(
        F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos"), F.count_distinct("source").alias("n_groups"),
        F.count_distinct(F.when(F.col("y") == 1, F.col("source"))).alias("n_makers"),
    )
    return ca.gated(area.crossJoin(held).crossJoin(sizes))  # one row each


R.add("score_gate", _gate)
