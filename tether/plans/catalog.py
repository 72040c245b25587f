"""Named queries over the sample tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tether.config import Config
from tether.functions import vectors
from tether.functions.address import PARTS, completeness, parse_address, states_agree
from tether.functions.phonetic import phonetic_tokens
from tether.functions.text import char_ngrams, title_case
from tether.operators import clustering, neighbors, reduction
from tether.operators.graph import connected_components
from tether.operators.ngram import idf, pair_similarity, similarity_join
from tether.plans import score, stages
from tether.plans.oracle import ADDR, NAME, PARTS_SQL, POINTS, SPLIT, Query, parsed
from tether.runtime.scratch import Scratch
from tether.sources.tables import entities, table

CFG = Config()
KEY = stages.KEY
Build = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Build] = {}
_oracles: dict[str, Callable[[], str]] = {}


def query(oracle: Callable[[], str] | None = None) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Build]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _oracles.items()}


def records(spark: SparkSession, d: str) -> DataFrame:
    return stages.add_address_key(stages.normalize(entities(spark, d)))


def clustered(spark: SparkSession, d: str, clusters: int = 200) -> DataFrame:
    """Records with clusters by part, every nineteenth being noise, and made-up probabilities."""
    cluster = F.when(F.col("rec_id") % 19 == 0, -1).otherwise(F.col("rec_id") % clusters).cast("bigint")
    return records(spark, d).withColumn("cluster", cluster).withColumn("cluster_probability", F.round(F.lit(0.5) + (F.col("rec_id") % 50) / 100.0, 2))


def prepared(df: DataFrame) -> DataFrame:
    """Written once, as later stages read it several times."""
    return Scratch(df.sparkSession).save(df, "prepared")


# names and addresses


@query(lambda: Query().records().select("select rec_id, normalized_text from n"))
def normalize_names(spark, d):
    return stages.normalize(entities(spark, d)).select("rec_id", "normalized_text")


@query(lambda: Query().records().select("select rec_id, addr_normalized_key from n"))
def address_key(spark, d):
    return records(spark, d).select("rec_id", KEY)


@query(lambda: Query().records().select(f"select rec_id, cast({POINTS} as integer) as score from n"))
def address_score(spark, d):
    return records(spark, d).select("rec_id", completeness().alias("score"))


@query(lambda: Query().add("e", Query().records().parts[0][1]).select(parsed(f"concat_ws(' ', {PARTS_SQL})")))
def address_parse(spark, d):
    return parse_address(entities(spark, d).select("rec_id", F.concat_ws(" ", *PARTS).alias("line")), F.col("line")).select("rec_id", *PARTS)


@query(lambda: Query().clustered().add("r", "select * from c where cluster <> -1").best_address("b", "r", "cluster").select(f"select cluster, addr_normalized_key, {PARTS_SQL}, freq, cast(score as integer) as score from b"))
def best_address(spark, d):
    return stages.best_address(clustered(spark, d).where("cluster <> -1"), "cluster")


@query(lambda: Query().clustered().add("r", "select * from c where cluster <> -1").names("b", "r", "cluster").select("select cluster, canonical_name, score from b"))
def canonical_name(spark, d):
    return stages.canonical_names(prepared(clustered(spark, d).where("cluster <> -1")), "cluster")


@query(lambda: Query().records().select("select rec_id, array_to_string(list_transform(regexp_extract_all(normalized_text, '(\\p{L}+|[^\\p{L}]+)'), lambda w: upper(w[1:1]) || lower(w[2:])), '') as title from n"))
def title_case_names(spark, d):
    return records(spark, d).select("rec_id", title_case(F.col("normalized_text")).alias("title"))


@query(lambda: Query().records().select("select g as gram, count(*) as n from (select substr(normalized_text, i, k) as g from n, unnest([3, 4, 5]) as kk(k), unnest(generate_series(1, length(normalized_text) - k + 1)) as ii(i)) group by all"))
def char_ngram_counts(spark, d):
    return records(spark, d).select(F.explode(char_ngrams(F.col("normalized_text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(lambda: Query().records().weights("t", "select normalized_text as s from n").select("select g as gram, df, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) as idf from td cross join tn"))
def ngram_idf(spark, d):
    return idf(records(spark, d).select(F.col("normalized_text").alias("s"))).withColumn("idf", F.round("idf", 6))


@query(lambda: Query().records().weights("t", "select normalized_text as s from n").select("select g as gram, cast(df as bigint) as df, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) as idf from td cross join tn where df >= 3 order by df desc, g limit 10000"))
def tfidf_vocabulary(spark, d):
    m = CFG.modeling.tfidf_params
    table = idf(records(spark, d).select(F.col("normalized_text").alias("s")), min_df=m["min_df"])
    return table.orderBy(F.desc("df"), "gram").limit(m["max_features"]).select("gram", "df", F.round("idf", 6).alias("idf"))


@query(lambda: Query().records().select("select rec_id, array_to_string(list_slice(string_split(normalized_text, ' '), 1, 5), ' ') as words from n"))
def word_tokens(spark, d):
    return records(spark, d).select("rec_id", F.array_join(F.slice(F.split("normalized_text", " "), 1, 5), " ").alias("words"))


@query(lambda: Query().clustered().add("q", "select rec_id, normalized_text as a, min(normalized_text) over (partition by cluster) as b from c").scored("t", "q", "a", "b", "similarity", False).select("select rec_id, round(similarity, 6) as similarity from tx"))
def string_similarity(spark, d):
    from pyspark.sql import Window as W

    q = clustered(spark, d).select("rec_id", F.col("normalized_text").alias("a"), F.min("normalized_text").over(W.partitionBy("cluster")).alias("b"))
    return pair_similarity(prepared(q)).select("rec_id", F.round("similarity", 6).alias("similarity"))


@query(lambda: Query().records().pairs("t", "select normalized_text as s from n", NAME).select("select a, b, similarity from tp"))
def similar_name_pairs(spark, d):
    return similarity_join(prepared(records(spark, d).select(F.col("normalized_text").alias("s")).distinct()), NAME)


@query(lambda: Query().records().pairs("t", "select addr_normalized_key as s from n", ADDR).select("select a, b, similarity from tp"))
def similar_address_pairs(spark, d):
    return similarity_join(prepared(records(spark, d).select(F.col(KEY).alias("s")).distinct()), ADDR)


@query(lambda: Query().records().pairs("t", "select addr_normalized_key as s from n", ADDR).components("g", "select a, b from tp").select("select vertex as address, component as first_address from g"))
def address_components(spark, d):
    from pyspark.sql import Window as W

    keys = prepared(records(spark, d).select(F.col(KEY).alias("s")).distinct())
    groups = connected_components(stages.id_edges(similarity_join(keys, ADDR)))
    named = groups.join(stages.key_ids(keys), F.col("vertex") == F.col("id"))
    return named.select(F.col("s").alias("address"), F.min("s").over(W.partitionBy("component_id")).alias("first_address"))


@query(
    lambda: Query().records().pairs("t", "select addr_normalized_key as s from n", ADDR).components("g", "select a, b from tp")
    .add("gr", "select n.*, g.component from n join g on g.vertex = n.addr_normalized_key").best_address("gb", "gr", "component")
    .select("select n.rec_id, coalesce(b.addr_normalized_key, n.addr_normalized_key) as addr_normalized_key from n left join g on g.vertex = n.addr_normalized_key left join gb b using (component)")
)
def consolidate_addresses(spark, d):
    return stages.consolidate_addresses(prepared(records(spark, d))).select("rec_id", KEY)


@query(
    lambda: Query().records().add("many", "select * from n where addr_normalized_key in (select addr_normalized_key from n group by all having count(distinct normalized_text) > 1)")
    .names("b", "many", "addr_normalized_key").select("select n.rec_id, coalesce(b.canonical_name, n.normalized_text) as normalized_text from n left join b using (addr_normalized_key)")
)
def names_by_address(spark, d):
    return stages.names_by_address(prepared(records(spark, d))).select("rec_id", "normalized_text")


# clusters


@query(lambda: Query().clustered().profiles("p", "c").select("select cluster, name, address, state, size, round(avg_probability, 6) as avg_probability from p"))
def cluster_profiles(spark, d):
    return stages.profiles(prepared(clustered(spark, d))).withColumn("avg_probability", F.round("avg_probability", 6))


@query(lambda: Query().records().select("select rec_id, coalesce(addr_state = 'IL' or (addr_state in ('IN', 'WI')), true) as agrees from n"))
def state_compat(spark, d):
    return records(spark, d).select("rec_id", states_agree(F.col("addr_state"), F.lit("IL"), (("IL", "IN"), ("WI", "IL"))).alias("agrees"))


@query(lambda: Query().validated().select("select rec_id, round(name_sim, 6) as name_sim, round(addr_sim, 6) as addr_sim, is_valid from v"))
def validate_members(spark, d):
    c = prepared(clustered(spark, d))
    v = stages.validate_members(c, prepared(stages.profiles(c)))
    return v.select("rec_id", F.round("name_sim", 6).alias("name_sim"), F.round("addr_sim", 6).alias("addr_sim"), "is_valid")


@query(lambda: Query().best().select("select rec_id, best_cluster, best_score, round(best_prob, 6) as best_prob from best"))
def best_cluster_search(spark, d):
    c = prepared(clustered(spark, d))
    prof = prepared(stages.profiles(c))
    bad = prepared(stages.validate_members(c, prof).where("not is_valid"))
    return stages.best_clusters(bad, prof).withColumn("best_prob", F.round("best_prob", 6))


@query(
    lambda: Query().best().select(
        "select rec_id, case when is_valid then cluster else coalesce(best_cluster, -1) end as cluster,"
        " round(case when is_valid then cluster_probability else coalesce(best_score * best_prob, 0.0) end, 6) as cluster_probability from v left join best using (rec_id)"
    )
)
def reassign_members(spark, d):
    return stages.reassign(prepared(clustered(spark, d))).select("rec_id", "cluster", F.round("cluster_probability", 6).alias("cluster_probability"))


@query(
    lambda: Query().validated().select(
        f"select rec_id, case when out then -1 else cluster end as cluster, case when out then 0.0 else cluster_probability end as cluster_probability from (select *, cluster <> -1 and (coalesce(round(addr_sim, 6) < {ADDR} and p_address is not null, false) or not coalesce(addr_state = p_state or addr_state is null or p_state is null, true)) as out from v)"
    )
)
def evict_members(spark, d):
    c = prepared(clustered(spark, d))
    return stages.evict(c, prepared(stages.profiles(c))).select("rec_id", "cluster", "cluster_probability")


@query(lambda: Query().exact().select("select loser, winner from x"))
def merge_exact_address(spark, d):
    return stages.merge_by_address(prepared(stages.profiles(prepared(clustered(spark, d, SPLIT)))))


@query(lambda: Query().fuzzy().select("select loser, winner from fw"))
def merge_fuzzy(spark, d):
    return stages.merge_by_similarity(prepared(stages.profiles(prepared(clustered(spark, d, SPLIT)))))


@query(
    lambda: _identical().select("select rec_id, coalesce(w.winner, i.k) as k from i left join w on w.loser = i.k")
)
def consolidate_identical(spark, d):
    rows = clustered(spark, d).withColumn("k", (F.col("rec_id") % 23).cast("bigint"))
    return stages.consolidate_identical(prepared(rows), "k").select("rec_id", "k")


def _identical() -> Query:
    q = Query().clustered().add("i", "select *, cast(rec_id % 23 as bigint) as k from c")
    q.add("ik", "select distinct normalized_text, addr_normalized_key, k from i")
    q.components("g", "select x.k as a, y.k as b from ik x join ik y on x.normalized_text = y.normalized_text and x.addr_normalized_key = y.addr_normalized_key where x.k <> y.k")
    q.add("is_", "select k, count(*) as size, round(avg(cluster_probability), 9) as p from i group by all")
    return q.add("w", "select vertex as loser, first_value(vertex) over (partition by component order by size desc, p desc, vertex) as winner from g join is_ on is_.k = vertex qualify loser <> winner")


@query(lambda: Query().enriched().select("select rec_id, addr_street_number, addr_street_name, addr_normalized_key, address_was_enriched from en"))
def enrich_address(spark, d):
    return stages.enrich(prepared(clustered(spark, d))).select("rec_id", *PARTS[:2], KEY, "address_was_enriched")


_STATE = (
    "select rec_id, case when s.n > 1 then t.top + dense_rank() over (partition by coalesce(s.n, 0) > 1 order by c.cluster, c.addr_state nulls first) else c.cluster end as final_cluster"
    " from c left join (select cluster, count(distinct addr_state) as n from c where cluster <> -1 group by all) s using (cluster) cross join (select max(cluster) as top from c) t"
)


@query(lambda: Query().clustered().select(_STATE))
def split_by_state(spark, d):
    return stages.split_by_state(prepared(clustered(spark, d).withColumn("final_cluster", F.col("cluster")))).select("rec_id", "final_cluster")


_STREET = (
    "select rec_id, case when s.wide then t.top + dense_rank() over (partition by coalesce(s.wide, false) order by u.cluster, u.addr_street_name nulls first, u.addr_zip nulls first, u.addr_street_number nulls first) else u.cluster end as final_cluster"
    " from u left join (select cluster, addr_street_name, addr_zip, true as wide from u where cluster <> -1 group by all having count(distinct num) > 1 and max(num) - min(num) > 50) s using (cluster, addr_street_name, addr_zip) cross join (select max(cluster) as top from u) t"
)


@query(lambda: Query().clustered().add("u", "select *, case when regexp_matches(addr_street_number, '^[0-9]+(\\.[0-9]+)?$') then cast(addr_street_number as double) end as num from c").select(_STREET))
def split_by_street_range(spark, d):
    return stages.split_by_street_range(prepared(clustered(spark, d).withColumn("final_cluster", F.col("cluster")))).select("rec_id", "final_cluster")


# results


def mapped(spark, d):
    rows = prepared(stages.enrich(prepared(clustered(spark, d))).withColumn("final_cluster", F.col("cluster")))
    return rows, prepared(stages.canonical_map(rows))


@query(lambda: Query().mapped().select(f"select final_cluster, canonical_name, addr_normalized_key, {PARTS_SQL}, round(avg_cluster_prob, 6) as avg_cluster_prob from m"))
def canonical_map(spark, d):
    return mapped(spark, d)[1].withColumn("avg_cluster_prob", F.round("avg_cluster_prob", 6))


@query(lambda: Query().mapped().select("select regexp_replace(canonical_name, ' - \\d+$', '') as name, count(*) as clusters, count(distinct canonical_name) as numbers from m group by all"))
def chain_numbering(spark, d):
    name = F.regexp_replace("canonical_name", r" - \d+$", "")
    return mapped(spark, d)[1].groupBy(name.alias("name")).agg(F.count("*").alias("clusters"), F.countDistinct("canonical_name").alias("numbers"))


def applied(spark, d):
    rows, cmap = mapped(spark, d)
    return score.apply_map(rows, cmap)


@query(lambda: Query().applied().select("select rec_id, canonical_name, canonical_address from ap"))
def apply_canonical(spark, d):
    return applied(spark, d).select("rec_id", "canonical_name", "canonical_address")


@query(lambda: Query().confident().select("select rec_id, round(name_similarity, 6) as name_similarity, round(address_confidence, 6) as address_confidence, size as cluster_size, round(cohesion, 6) as cohesion_score, change_magnitude, confidence_score from sc"))
def confidence_score(spark, d):
    s = score.score(prepared(applied(spark, d)))
    return s.select("rec_id", *[F.round(c, 6).alias(c) for c in ("name_similarity", "address_confidence")], F.col("cluster_size").cast("bigint").alias("cluster_size"), F.round("cohesion_score", 6).alias("cohesion_score"), "change_magnitude", "confidence_score")


def flagged(spark, d):
    return prepared(score.flag(score.score(prepared(applied(spark, d)))))


@query(lambda: Query().confident().select("select confidence_category, count(*) as records from sc group by all"))
def confidence_category(spark, d):
    return score.score(prepared(applied(spark, d))).groupBy("confidence_category").agg(F.count("*").alias("records"))


@query(lambda: Query().flagged().select("select rec_id, needs_review, review_reason from fl"))
def review_flags(spark, d):
    return flagged(spark, d).select("rec_id", "needs_review", "review_reason")


@query(lambda: Query().flagged().select("select reason, count(*) as records from (select unnest(string_split(review_reason, ',')) as reason from fl where needs_review) group by all"))
def review_reason_counts(spark, d):
    return score.reason_counts(flagged(spark, d))


@query(lambda: Query().applied().select(f"select distinct company_name as original_name, trim(regexp_replace(concat_ws(' ', {PARTS_SQL}), '\\s+', ' ', 'g')) as original_address, canonical_name, canonical_address from ap"))
def review_table(spark, d):
    from dataclasses import replace

    return score.review_table(applied(spark, d), replace(CFG, columns=replace(CFG.columns, address_cols=PARTS)))


@query(lambda: Query().clustered().select("select count(*) as count, round(avg(size), 6) as mean, round(stddev_samp(size), 6) as std, min(size)::double as min, quantile_cont(size, 0.25)::double as p25, quantile_cont(size, 0.5)::double as p50, quantile_cont(size, 0.75)::double as p75, max(size)::double as max from (select cluster, count(*) as size from c where cluster <> -1 group by all)"))
def cluster_size_describe(spark, d):
    out = score.describe(clustered(spark, d).where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("size")), "size")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


def _report() -> str:
    d = lambda section, src, v: [f"select '{section}' as section, '{m}' as metric, round(({e})::double, 6) as value from {src}" for m, e in (("count", f"count({v})"), ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("min", f"min({v})"), ("p25", f"quantile_cont({v}, 0.25)"), ("p50", f"quantile_cont({v}, 0.5)"), ("p75", f"quantile_cont({v}, 0.75)"), ("max", f"max({v})"))]
    one = lambda s, m, e: f"select '{s}' as section, '{m}' as metric, round(({e})::double, 6) as value from fl"
    rows = [
        one("summary", "total_records", "count(*)"),
        one("summary", "unique_entities_before", "count(distinct company_name)"),
        one("summary", "unique_entities_after", "count(distinct canonical_name)"),
        one("summary", "reduction_rate", "1.0 - count(distinct canonical_name)::double / greatest(count(distinct company_name), 1)"),
        one("summary", "records_changed", "count(*) filter (lower(company_name) <> lower(canonical_name))"),
        one("clustering", "clusters_found", "count(distinct case when final_cluster <> -1 then final_cluster end)"),
        one("clustering", "unclustered_records", "count(*) filter (final_cluster = -1)"),
        one("clustering", "chain_entities_found", "count(*) filter (regexp_matches(canonical_name, ' - \\d+$'))"),
        one("clustering", "enriched_addresses", "count(*) filter (address_was_enriched)"),
        one("review", "records_for_review", "count(*) filter (needs_review)"),
        *d("cluster_size", "sz", "size"),
        *d("confidence", "fl", "confidence_score"),
        "select 'review_reason' as section, reason as metric, count(*)::double as value from (select unnest(string_split(review_reason, ',')) as reason from fl where needs_review) group by all",
    ]
    return Query().flagged().add("sz", "select final_cluster, count(*) as size from fl where final_cluster <> -1 group by all").select("\nunion all ".join(rows))


@query(_report)
def report_summary(spark, d):
    return score.report(flagged(spark, d))


@query(lambda: Query().clustered(SPLIT).select("select normalized_text, addr_normalized_key, count(distinct cluster) as clusters from c where cluster <> -1 group by all having count(distinct cluster) > 1"))
def identity_violations(spark, d):
    return score.identity_violations(clustered(spark, d, SPLIT))


@query(lambda: Query().applied().select("select canonical_name, count(distinct canonical_address) + max(case when canonical_address is null then 1 else 0 end) as addresses from ap group by all having addresses > 1"))
def canonical_violations(spark, d):
    return score.canonical_violations(applied(spark, d))


@query()
def resolve_records(spark, d):
    from tether.plans.resolver import Resolver

    return Resolver(parsed=True).fit_transform(entities(spark, d)).select("rec_id", "final_cluster", "canonical_name", "canonical_address", "confidence_score", "confidence_category", "needs_review", "review_reason")


@query()
def resolve_new_records(spark, d):
    from tether.plans.resolver import Resolver

    rows = entities(spark, d)
    return Resolver(parsed=True).fit(rows).transform(rows).select("rec_id", "final_cluster", "canonical_name", "canonical_address", "is_new_entity")


# vectors

_UNIT = "select vec_id as id, list_transform(embedding, lambda x: x::double) as vec, label from embeddings"
_COS = "select x.id as src, y.id as dst, round(list_inner_product(x.vec, y.vec) / (sqrt(list_inner_product(x.vec, x.vec)) * sqrt(list_inner_product(y.vec, y.vec))), 6) as similarity from u x join u y on {}"


def vectors_of(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _knn(k: int, where: str = "x.id <> y.id") -> Query:
    return Query().add("u", _UNIT).add("cos", _COS.format(where)).add("nn", f"select *, row_number() over (partition by src order by similarity desc, dst) - 1 as rank from cos qualify rank < {k}")


@query(lambda: _knn(5).select("select src, dst, similarity, cast(rank as integer) as rank from nn"))
def knn_graph(spark, d):
    return neighbors.nearest(vectors_of(spark, d), 5)


@query(lambda: _knn(10).select("select dst as source, src as dest, round(1.0 - similarity, 6) as distance from nn where round(1.0 - similarity, 6) < 0.7"))
def edge_list(spark, d):
    return neighbors.edges_within(neighbors.nearest(vectors_of(spark, d), 10), 0.7)


@query(lambda: _knn(10, "true").select("select x.src, x.dst, round(((x.similarity + y.similarity) / 2) / (x.rank + y.rank + 2), 9) as weight from nn x join nn y on x.src = y.dst and x.dst = y.src where x.src < x.dst"))
def mutual_rank_graph(spark, d):
    return neighbors.mutual_ranks(vectors_of(spark, d), 10)


@query(lambda: _knn(10).components("g", "select src as a, dst as b from nn where similarity > 0.35").select("select vertex, component as component_id from g"))
def vector_components(spark, d):
    near = neighbors.nearest(vectors_of(spark, d), 10).where("similarity > 0.35")
    return connected_components(near.select("src", "dst"))


def _attach() -> str:
    q = _knn(15).add("lab", "select id, cast(case when id % 4 = 0 then -1 else label end as bigint) as label from u")
    q.add("votes", "select nn.src, l.label, count(*) as n, round(avg(similarity), 9) as mean, count(*) filter (similarity >= 0.25) as near from nn join lab z on z.id = nn.src and z.label = -1 join lab l on l.id = nn.dst and l.label <> -1 group by all")
    q.add("rk", "select *, row_number() over w as k, lead(mean) over w as second from votes window w as (partition by src order by n desc, mean desc, label)")
    q.add("got", "select src, label as got from rk where k = 1 and (second is null or mean / (second + 1e-8) >= 1.05) and n >= 2 and near >= 2 and mean >= 0.25")
    return q.select("select id, coalesce(got, label) as label from lab left join got on src = id")


@query(_attach)
def attach_noise(spark, d):
    rows = vectors_of(spark, d)
    labels = rows.select("id", F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("label")).cast("bigint").alias("label"))
    return neighbors.attach_noise(neighbors.nearest(rows, 15), labels, 0.25, 2, 1.05)


def _centroids() -> Query:
    q = Query().add("u", _UNIT).add("parts", "select label, i, avg(vec[i]) as x from u, unnest(generate_series(1, 64)) as ii(i) group by all")
    return q.add("cent", "select label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from (select label, list(x order by i) as v from parts group by all)")


@query(lambda: _centroids().select("select label, round(v[1], 6) as first, round(list_sum(v), 6) as total from cent"))
def label_centroids(spark, d):
    rows = vectors_of(spark, d)
    c = neighbors.centroids(rows.select("id", "vec"), rows.select("id", "label"))
    return c.select("label", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    lambda: _centroids().add("mem", "select id, label, vec from u")
    .add("close", "select x.label as a, y.label as b from cent x join cent y on x.label < y.label where round(list_inner_product(x.v, y.v), 6) > 0.02")
    .add("prs", "select a, b, round(list_inner_product(list_transform(x.vec, lambda q: q / sqrt(list_inner_product(x.vec, x.vec))), list_transform(y.vec, lambda q: q / sqrt(list_inner_product(y.vec, y.vec)))), 6) as s from close join mem x on x.label = a join mem y on y.label = b")
    .select("select a::bigint as a, b::bigint as b, round(median(s), 6) as median_sim, max(s) as max_sim from prs group by all having median(s) >= -1")
)
def centroid_merge_candidates(spark, d):
    rows = vectors_of(spark, d)
    return neighbors.merge_candidates(rows.select("id", "vec"), rows.select("id", "label"), 0.02, -1.0, -1.0, 1_000_000)


def _ensemble() -> str:
    q = Query().add("r", "select vec_id as id, cast(case when vec_id % 3 = 0 then -1 else label end as bigint) as hdb, cast(case when vec_id % 11 = 0 then -1 when vec_id % 7 = 0 then 100 + vec_id % 5 else 50 + label end as bigint) as snn, 0.9::double as probability from embeddings")
    q.add("ov", "select snn, hdb, count(*) as n from r where hdb <> -1 and snn <> -1 group by all")
    q.add("mp", "select snn, hdb as to_ from (select *, sum(n) over (partition by snn) as every, row_number() over (partition by snn order by n desc, hdb) as k from ov) where k = 1 and n / every >= 0.75 and n >= 2")
    q.add("ids", "select snn, (select max(hdb) from r) + row_number() over (order by n desc, snn) as new_ from (select snn, count(*) as n from r where snn <> -1 and snn not in (select snn from mp) group by all having count(*) >= 4)")
    return q.select("select id, case when hdb <> -1 then hdb when to_ is not null then to_ when new_ is not null then new_ else hdb end as cluster, case when hdb = -1 and (to_ is not null or new_ is not null) then 0.6 else probability end as cluster_probability, case when hdb = -1 and to_ is not null then 1 when hdb = -1 and new_ is not null then 2 else 0 end as label_source from r left join mp using (snn) left join ids using (snn)")


@query(_ensemble)
def label_ensemble(spark, d):
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(
        v.alias("id"), F.when(v % 3 == 0, -1).otherwise(F.col("label")).cast("bigint").alias("hdb"),
        F.when(v % 11 == 0, -1).when(v % 7 == 0, 100 + v % 5).otherwise(50 + F.col("label")).cast("bigint").alias("snn"), F.lit(0.9).alias("probability"),
    )
    return neighbors.ensemble_labels(rows)


@query(
    lambda: Query().add("u", _UNIT).add("m", "select avg(list_inner_product(vec, vec)) as e from u")
    .select("select id, round(list_sum(vec) * sqrt(0.45 / 0.85 / (e + 1e-8)), 6) as semantic, round(2 * list_sum(vec) * sqrt(0.4 / 0.85 / (4 * e + 1e-8)), 6) as tfidf from u cross join m")
)
def stream_energy_balance(spark, d):
    rows = vectors_of(spark, d).select("id", F.col("vec").alias("semantic"), F.transform("vec", lambda x: 2 * x).alias("tfidf"))
    out = vectors.balance_streams(rows, CFG.modeling.stream_proportions)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6).alias(c)
    return out.select("id", total("semantic"), total("tfidf"))


@query(lambda: Query().add("u", _UNIT).select("select id, round(vec[1] / (sqrt(list_inner_product(vec, vec)) + 1e-8), 6) as first, round(list_sum(vec) / (sqrt(list_inner_product(vec, vec)) + 1e-8), 6) as total from u"))
def l2_normalize(spark, d):
    v = vectors_of(spark, d).select("id", vectors.l2_normalize(F.col("vec")).alias("v"))
    return v.select("id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query()
def phonetic_codes(spark, d):
    return records(spark, d).select("rec_id", phonetic_tokens(F.col("normalized_text")).alias("codes"))


@query()
def louvain_labels(spark, d):
    graph = prepared(neighbors.mutual_ranks(vectors_of(spark, d), 10))
    return clustering.louvain(graph)


@query()
def hdbscan_labels(spark, d):
    return clustering.hdbscan(vectors_of(spark, d).select("id", "vec"), epsilon=0.0)


@query()
def svd_project(spark, d):
    rows = vectors_of(spark, d).select("id", "vec")
    return reduction.truncated_svd(rows, 8).apply(rows).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def pca_project(spark, d):
    rows = vectors_of(spark, d).select("id", "vec")
    return reduction.pca(rows, 8).apply(rows).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def consensus_embedding(spark, d):
    rows = vectors_of(spark, d).select("id", F.col("vec").alias("one"), F.slice("vec", 1, 32).alias("two"))
    return reduction.consensus(rows, ["one", "two"], CFG.modeling.umap_params["n_components"], CFG.modeling.cosine_consensus_n_samples).apply(rows).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))
