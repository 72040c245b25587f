"""SQL of the queries that SQL can express, for DuckDB."""

OP1 = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from t, unnest(generate_series(1, greatest(len(w) - 4, 1))) as u(i) where len(w) > 0),
n as (select t.doc_id, count(s.g) as n from t left join s using (doc_id) group by all),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as seen from n union select r.a, e.b from r join e on e.a = r.seen)
select n.doc_id, n.n as n_shingles, min(r.seen) as component_id, n.doc_id = min(r.seen) as kept from n join r on r.a = n.doc_id group by n.doc_id, n.n
"""

OP7 = """
with recursive t as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select vec_id, v, sqrt(list_inner_product(v, v)) as n from t where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
e as (select x.vec_id as a, y.vec_id as b from g x join g y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_inner_product(x.v, y.v) / (x.n * y.n) >= 0.9),
r as (select vec_id as a, vec_id as seen from t union select r.a, e.b from r join e on e.a = r.seen),
c as (select a, min(seen) as c from r group by all),
l as (select a, count(*) as n from e group by all)
select t.vec_id, coalesce(l.n, 0) as n_links, c.c as component_id, t.vec_id = c.c as kept from t join c on c.a = t.vec_id left join l on l.a = t.vec_id
"""
