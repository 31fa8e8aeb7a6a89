"""Queries over vectors and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.operators import statistics as st, topics as to, vectors as ve
from legajo.plans import corpus as co
from legajo.plans.corpus import Registry, T
from legajo.session import table

R = Registry()
_U = """u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u,
 embedding from embeddings),
pl as (select label, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: x::double)) as x from embeddings), mm as (select label, i, avg(x) as m from pl group by all),
mr as (select label, list(m order by i) as m from mm group by 1), me as (select label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) as m from mr)"""

R.add(
    "similarity_to_means",
    lambda s, d: ve.similarity_to_means(table(s, d, "embeddings"), "vec_id", "label", "embedding").select("vec_id", "label", F.round("cosine", 5).alias("cosine")),
    f"with {_U} select vec_id, u.label, round(list_dot_product(u, m), 5) as cosine from u join me using (label)",
)
R.add(
    "label_similarity",
    lambda s, d: ve.group_similarity(table(s, d, "embeddings"), "label", "embedding").select("a", "b", F.round("cosine", 5).alias("cosine")),
    f"with {_U} select x.label as a, y.label as b, round(list_dot_product(x.m, y.m), 5) as cosine from me x join me y on x.label < y.label",
)
R.add(
    "vector_continuity",
    lambda s, d: ve.continuity(table(s, d, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("continuity", 5).alias("continuity"), "n"),
    f"""with {_U}, q as (select label, u, lag(u) over (partition by label order by vec_id) as b from u)
select label, round(avg(list_dot_product(u, b)), 5) as continuity, count(*) as n from q where b is not null group by 1""",
)
R.add(
    "label_agreement",
    lambda s, d: ve.agreement(co.claims(s, d), "claim_type", "verification_status").select("n", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi")),
    f"""with {co.C}, k as (select claim_type as a, verification_status as b, count(*) as n from c where claim_type is not null and verification_status is not null group by all),
ra as (select a, sum(n) as n from k group by 1), rb as (select b, sum(n) as n from k group by 1), t as (select sum(n)::double as t from k),
z as (select t, (select sum(n * (n - 1) / 2) from k) as cab, (select sum(n * (n - 1) / 2) from ra) as ca, (select sum(n * (n - 1) / 2) from rb) as cb,
 (select -sum(n / t.t * ln(n / t.t)) from k, t) as hab, (select -sum(n / t.t * ln(n / t.t)) from ra, t) as ha, (select -sum(n / t.t * ln(n / t.t)) from rb, t) as hb from t)
select t::bigint as n, round((cab - ca * cb / (t * (t - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (t * (t - 1) / 2)), 6) as ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) as nmi from z""",
)
R.add(
    "label_silhouette",
    lambda s, d: ve.silhouette_by_means(table(s, d, "embeddings"), "label", "embedding").select(F.round("silhouette", 5).alias("silhouette"), "n"),
    f"""with {_U}, x as (select vec_id, u.label, me.label as g, 1 - list_dot_product(u, m) as dist from u, me),
y as (select vec_id, min(dist) filter (label = g) as a, min(dist) filter (label <> g) as b from x group by 1) select round(avg((b - a) / greatest(a, b)), 5) as silhouette, count(*) as n from y""",
)
R.add(
    "chapter_divergence",
    lambda s, d: _divergence(s, d),
    f"""with {T}, w as (select unnest({co.tx.WORDS and ['de', 'la', 'el', 'en', 'los', 'por', 'del', 'con', 'y', 'a']!r}) as token), ch as (select distinct chapter from t where chapter is not null),
g as (select ch.chapter, w.token, count(t.token) as n from ch cross join w left join t on t.chapter = ch.chapter and t.token = w.token group by all),
v as (select chapter, token, (n + 1e-9) / sum(n + 1e-9) over (partition by chapter) as p from g),
j as (select x.chapter as a, y.chapter as b, x.p as p, y.p as q from v x join v y on x.token = y.token and x.chapter < y.chapter)
select a, b, round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 8) as divergence from j group by all""",
)


def _divergence(s, d):
    """Divergence of the use of function words between chapters (few, a dimension of the collection)."""
    words = ["de", "la", "el", "en", "los", "por", "del", "con", "y", "a"]
    t = co.tokens(s, d).where(F.col("chapter").isNotNull())
    v = t.groupBy("chapter").agg(F.array(*[F.count_if(F.col("token") == w) for w in words]).alias("v"))
    a, b = v.select(F.col("chapter").alias("a"), F.col("v").alias("va")), v.select(F.col("chapter").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(ve.divergence(F.col("va"), F.col("vb")), 8).alias("divergence"))


def _assigned(s, d):
    """A deterministic assignment of paragraphs to topics: the most frequent wanted word."""
    words = ["obras", "contrato", "compras", "energía", "aguas", "control"]
    t = co.tokens(s, d)
    w = t.groupBy("paragraph_id", "chapter").agg(F.array(*[F.count_if(F.col("token") == x) for x in words]).alias("w")).where(F.array_max("w") > 0)
    return to.dominant(w, "paragraph_id", "w").join(w.select("paragraph_id", "chapter"), "paragraph_id")


_ASSIGNED = f"""{T}, q as (select paragraph_id, chapter, [""" + ", ".join(
    f"count(*) filter (token = '{x}')" for x in ["obras", "contrato", "compras", "energía", "aguas", "control"]
) + """] as w from t group by all),
g as (select paragraph_id, chapter, list_position(w, list_max(w)) - 1 as topic, list_max(w) as weight from q where list_max(w) > 0)"""
R.add(
    "dominant_topics",
    lambda s, d: _assigned(s, d).select("paragraph_id", "topic", F.col("weight").cast("bigint").alias("weight")),
    f"with {_ASSIGNED} select paragraph_id, topic::int as topic, weight from g",
)
R.add(
    "topic_shares",
    lambda s, d: to.topic_shares(_assigned(s, d), "chapter"),
    f"with {_ASSIGNED} select chapter, topic::int as topic, count(*) as n, round(count(*) / sum(count(*)) over (partition by chapter), 4) as share from g where chapter is not null group by chapter, topic",
)
R.add(
    "topic_class_terms",
    lambda s, d: st.top_per_group(
        to.class_terms(_assigned(s, d), co.tokens(s, d).where(F.length("token") > 3), "paragraph_id").withColumn("weight", F.round("weight", 7)), ["topic"], [F.desc("weight"), F.col("token")], 12
    ),
    f"""with {_ASSIGNED}, k as (select topic, token, count(*) as n from t join (select paragraph_id, topic from g) using (paragraph_id) where length(token) > 3 group by all),
z as (select topic, sum(n) as size from k group by 1), o as (select token, sum(n) as total from k group by 1),
w as (select topic, token, round(n / size * ln(1 + (select avg(size) from z) / total), 7) as weight from k join z using (topic) join o using (token))
select topic::int as topic, token, weight, row_number() over (partition by topic order by weight desc, token)::int as rank from w qualify rank <= 12""",
)
R.add(
    "topic_coherence",
    lambda s, d: to.coherence(
        s.createDataFrame([(0, "obras"), (0, "contrato"), (0, "mantenimiento"), (1, "aguas"), (1, "energía"), (1, "control")], "topic int, token string"),
        co.tokens(s, d), ["paragraph_id"], ["sent_no", "pos"],
    ).select("topic", F.round("npmi", 6).alias("npmi")),
    f"""with {T}, o as (select paragraph_id, token, row_number() over (partition by paragraph_id order by sent_no, pos) - 1 as i, count(*) over (partition by paragraph_id) as n from t),
tot as (select sum(greatest(n - 9, 1)) as total from (select distinct paragraph_id, n from o)),
tt as (select * from (values (0, 'obras'), (0, 'contrato'), (0, 'mantenimiento'), (1, 'aguas'), (1, 'energía'), (1, 'control')) v(topic, token)),
e as (select distinct paragraph_id, token, unnest(range(greatest(i - 9, 0), least(i, greatest(n - 10, 0)) + 1)) as win from o where token in (select token from tt)),
si as (select token, count(*) as c from e group by 1),
bo as (select x.token as a, y.token as b, count(*) as c from e x join e y on x.paragraph_id = y.paragraph_id and x.win = y.win and x.token < y.token group by all),
pr as (select x.topic, x.token as a, y.token as b from tt x join tt y on x.topic = y.topic and x.token < y.token),
f as (select topic, (coalesce(bo.c, 0) + 1e-12) / total as p, sa.c / total as pa, sb.c / total as pb from pr left join bo using (a, b) join si sa on sa.token = a join si sb on sb.token = b, tot)
select topic, round(avg(ln(p / (pa * pb)) / -ln(p)), 6) as npmi from f group by 1""",
)
R.add("embedding_clusters", lambda s, d: ve.kmeans(table(s, d, "embeddings"), "vec_id", "embedding", 10))
R.add("embedding_map", lambda s, d: ve.principal_components(table(s, d, "embeddings"), "vec_id", "embedding"))


def _lda(s, d):
    vectors, _ = to.counted(co.tokens(s, d), "paragraph_id")
    return to.lda(vectors, "paragraph_id", 6)[0]


R.add("lda_topics", _lda)

R.add(
    "nmf_topics",
    lambda s, d: to.nmf(
        st.tf_idf(co.tokens(s, d), ["paragraph_id"], least_tokens=20).select("paragraph_id", "token", F.col("tfidf").alias("w")), "paragraph_id", 13
    ),
)


R.add("topic_examples", lambda s, d: to.topic_examples(_lda(s, d), co.analytic(s, d), "paragraph_id", "clean_text"))
