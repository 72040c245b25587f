"""The catalogue's queries in SQL, put together from named parts."""

from __future__ import annotations

import re

from tether.config import Config
from tether.functions.address import PARTS, STREET_WORDS
from tether.functions.text import ALSO_KNOWN
from tether.sources.tables import ENTITY_SQL

CFG = Config()
V = CFG.validation
NAME, ADDR = V.name_fuzz_ratio / 100.0, V.address_fuzz_ratio / 100.0
PARTS_SQL = ", ".join(PARTS)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def squeezed(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def normal(col: str) -> str:
    x = f"replace(replace(lower(coalesce({col}, '')), '&', ' and '), '+', ' and ')"
    x = sub(x, r"\([^)]*\)", "")
    x = f"(select case when regexp_matches(v, {lit(ALSO_KNOWN)}) then regexp_extract(v, {lit(ALSO_KNOWN)}, 1) else v end from (select {x} as v))"
    for old, new in CFG.normalization.replacements.items():
        x = sub(x, rf"\b{re.escape(old)}\b", new)
    x = sub(x, r"\b(" + "|".join(re.escape(s) for s in CFG.normalization.suffixes_to_remove) + r")\b", "")
    return squeezed(sub(sub(x, r"[^\w\s]", " "), r"\s+\d+$", ""))


ADDRESS_KEY = squeezed("lower(concat_ws(' ', " + ", ".join(f"coalesce({p}, '')" for p in PARTS) + "))")
POINTS = "(case when addr_street_name <> '' then 2 else 0 end + case when addr_street_number <> '' then 1 else 0 end + case when addr_city <> '' then 1 else 0 end + case when length(addr_state) = 2 then 1 else 0 end + case when regexp_matches(addr_zip, '^[0-9]{5}$') then 1 else 0 end)"
SIZE_FACTOR = "least(ln(1 + size) / ln(11), 1.0)"


#: With this many clusters each part's records lie in three, which gives merges and violations to find.
SPLIT = 600


class Query:
    """A chain of common table expressions."""

    def __init__(self):
        self.parts: list[tuple[str, str]] = []
        self.recursive = False

    def add(self, name: str, sql: str) -> Query:
        if name not in [n for n, _ in self.parts]:
            self.parts.append((name, sql))
        return self

    def select(self, sql: str) -> str:
        head = "with recursive " if self.recursive else "with "
        return head + ",\n".join(f"{n} as ({s})" for n, s in self.parts) + "\n" + sql

    # the parts

    def records(self) -> Query:
        self.add("e", ENTITY_SQL.format(customer="customer", part="part", nation="nation"))
        return self.add("n", f"select *, {normal('company_name')} as normalized_text, {ADDRESS_KEY} as addr_normalized_key from e")

    def clustered(self, clusters: int = 200) -> Query:
        self.records()
        return self.add("c", f"select *, cast(case when rec_id % 19 = 0 then -1 else rec_id % {clusters} end as bigint) as cluster, round(0.5 + (rec_id % 50) / 100.0, 2)::double as cluster_probability from n")

    def weights(self, p: str, strings: str, min_df: int = 2, sublinear: bool = True, by: str = "") -> Query:
        """{p}w(by, s, g, df, w) of the distinct strings of ``strings``, which selects (by, s)."""
        b, on = (f"{by}, ", f"and x.{by} = y.{by}") if by else ("", "")
        self.add(f"{p}s", f"select distinct {b}s from ({strings})")
        self.add(f"{p}t", f"select {b}s, substr(z, i, k) as g, count(*) as tf from (select *, {sub('lower(s)', r'\s+', ' ')} as z from {p}s), unnest([3, 4, 5]) as kk(k), unnest(generate_series(1, length(z) - k + 1)) as ii(i) group by all")
        self.add(f"{p}d", f"select {b}g, count(*) as df from {p}t group by all having count(*) >= {min_df}")
        self.add(f"{p}n", f"select {b}count(*) as n from {p}s group by all" if by else f"select count(*) as n from {p}s")
        tf = "1.0 + ln(tf)" if sublinear else "tf"
        join = f"join {p}n z on z.{by} = x.{by}" if by else f"cross join {p}n z"
        self.add(f"{p}r", f"select x.{by + ', x.' if by else ''}s, x.g, y.df, ({tf}) * (ln((1.0 + z.n) / (1.0 + y.df)) + 1.0) as r from {p}t x join {p}d y on x.g = y.g {on} {join}")
        return self.add(f"{p}w", f"select {b}s, g, df, r / sqrt(sum(r * r) over (partition by {b}s)) as w from {p}r")

    def pairs(self, p: str, strings: str, threshold: float, op: str = ">") -> Query:
        """{p}p(a, b, similarity) of distinct strings with a < b."""
        self.weights(p, strings)
        return self.add(f"{p}p", f"select x.s as a, y.s as b, round(sum(x.w * y.w), 6) as similarity from {p}w x join {p}w y on x.g = y.g and x.s < y.s group by all having round(sum(x.w * y.w), 6) {op} {threshold}")

    def alike(self, p: str, left: str, right: str, threshold: float) -> Query:
        """{p}a(a, b, similarity) both ways, at the threshold or above, equal non-empty strings included."""
        self.pairs(p, f"{left} union {right}", threshold, ">=")
        return self.add(f"{p}a", f"select a, b, similarity from {p}p union all select b, a, similarity from {p}p union all select s, s, 1.0 from (({left}) intersect ({right})) where s <> ''")

    def scored(self, p: str, source: str, a: str, b: str, out: str, one: bool = True) -> Query:
        """{p}x: the rows of ``source`` with the cosine of two columns."""
        x, y = f"coalesce(t.{a}, '')", f"coalesce(t.{b}, '')"
        self.weights(p, f"select {x} as s from {source} t union select {y} from {source} t")
        self.add(f"{p}q", f"select distinct {x} as a, {y} as b from {source} t")
        self.add(f"{p}v", f"select q.a, q.b, sum(x.w * y.w) as dot from {p}q q join {p}w x on x.s = q.a join {p}w y on y.s = q.b and y.g = x.g group by all")
        same = f"when {x} = {y} and {x} <> '' then 1.0" if one else "when false then 1.0"
        return self.add(f"{p}x", f"select t.*, case {same} else coalesce(v.dot, 0.0) end as {out} from {source} t left join {p}v v on v.a = {x} and v.b = {y}")

    def best_address(self, p: str, source: str, by: str) -> Query:
        """{p}(by, key, parts, freq, score)."""
        self.add(f"{p}_f", f"select {by}, addr_normalized_key, count(*) as freq, min((-{POINTS}, {PARTS_SQL})) as m from {source} group by all")
        cols = ", ".join(f"struct_extract_at(m, {k + 2}) as {c}" for k, c in enumerate(PARTS))
        self.add(f"{p}_g", f"select {by}, addr_normalized_key, freq, {cols} from {p}_f")
        return self.add(p, f"select * from (select *, {POINTS} as score from {p}_g) qualify row_number() over (partition by {by} order by score desc, freq desc, addr_normalized_key) = 1")

    def names(self, p: str, source: str, by: str) -> Query:
        """{p}(by, canonical_name, score)."""
        self.add(f"{p}_c", f"select {by}, normalized_text as s, count(*) as c, count(*) / sum(count(*)) over (partition by {by}) as f, count(*) over (partition by {by}) as kinds from {source} group by {by}, normalized_text")
        self.weights(f"{p}_", f"select {by}, s from {p}_c where kinds > 1", 1, False, by)
        self.add(f"{p}_m", f"select w.{by}, w.g, sum(w.w * c.f) as m from {p}_w w join {p}_c c on c.{by} = w.{by} and c.s = w.s group by all")
        self.add(f"{p}_l", f"select w.{by}, w.s, sum(w.w * m.m) as l from {p}_w w join {p}_m m on m.{by} = w.{by} and m.g = w.g group by all")
        self.add(f"{p}_o", f"select c.{by}, c.s, round((coalesce(l.l, 0.0) + c.f) * least(ln(length(c.s) + 1.0), 3.5), 6) as score from {p}_c c left join {p}_l l on l.{by} = c.{by} and l.s = c.s")
        return self.add(p, f"select {by}, s as canonical_name, score from {p}_o qualify row_number() over (partition by {by} order by score desc, s) = 1")

    def profiles(self, p: str, source: str, by: str = "cluster") -> Query:
        """{p}({by}, name, address, state, size, avg_probability)."""
        self.add(f"{p}r", f"select * from {source} where {by} <> -1")
        self.names(f"{p}nm", f"{p}r", by).best_address(f"{p}ad", f"{p}r", by)
        self.add(f"{p}st", f"select {by}, count(normalized_text) as size, avg(cluster_probability) as avg_probability from {p}r group by all")
        return self.add(p, f"select {by}, n.canonical_name as name, a.addr_normalized_key as address, a.addr_state as state, size, avg_probability from {p}nm n join {p}ad a using ({by}) join {p}st using ({by})")

    def components(self, p: str, edges: str) -> Query:
        """{p}(vertex, component) with the smallest member, of edges (a, b)."""
        self.recursive = True
        self.add(f"{p}_e", f"select a, b from ({edges}) union select b, a from ({edges})")
        self.add(f"{p}_r", f"select a as vertex, a as seen from {p}_e union select r.vertex, e.b from {p}_r r join {p}_e e on e.a = r.seen")
        return self.add(p, f"select vertex, min(seen) as component from {p}_r group by all")

    def validated(self) -> Query:
        self.clustered().profiles("p", "c")
        self.add("c1", "select c.*, p.name as p_name, p.address as p_address, p.state as p_state from c left join p using (cluster)")
        self.scored("vn", "c1", "normalized_text", "p_name", "name_sim").scored("va", "vnx", "addr_normalized_key", "p_address", "addr_sim")
        ok = f"coalesce(round(name_sim, 6) >= {NAME} and round(addr_sim, 6) >= {ADDR} and cluster <> -1 and coalesce(addr_state = p_state or addr_state is null or p_state is null, true), false)"
        return self.add("v", f"select *, {ok} as is_valid from vax")

    def best(self) -> Query:
        self.validated().add("misfit", "select * from v where not is_valid")
        self.alike("bn", "select normalized_text as s from misfit", "select name as s from p", NAME)
        self.alike("ba", "select addr_normalized_key as s from misfit", "select address as s from p", ADDR)
        w = V.reassignment_scoring_weights
        score = f"round({w['name_similarity']} * x.similarity + {w['address_similarity']} * y.similarity + {w['cluster_size']} * {SIZE_FACTOR} + {w['cluster_probability']} * avg_probability, 6)"
        self.add("bp", f"select r.rec_id, p.cluster, p.avg_probability, {score} as score from misfit r join bna x on x.a = r.normalized_text join p on p.name = x.b join baa y on y.a = r.addr_normalized_key and y.b = p.address where coalesce(r.addr_state = p.state or r.addr_state is null or p.state is null, true)")
        return self.add("best", "select rec_id, cluster as best_cluster, score as best_score, avg_probability as best_prob from bp qualify row_number() over (partition by rec_id order by score desc, cluster) = 1")

    def exact(self) -> Query:
        self.clustered(SPLIT).profiles("p", "c")
        return self.add("x", "select cluster as loser, first_value(cluster) over (partition by address order by size desc, cluster) as winner from p qualify loser <> winner")

    def fuzzy(self) -> Query:
        self.clustered(SPLIT).profiles("p", "c")
        self.pairs("fn", "select name as s from p", NAME).pairs("fa", "select address as s from p", ADDR)
        self.add("fe", "select x.cluster as a, y.cluster as b from p x join p y on x.cluster < y.cluster where (x.name = y.name or exists (select 1 from fnp q where q.a = least(x.name, y.name) and q.b = greatest(x.name, y.name))) and (x.address = y.address or exists (select 1 from fap q where q.a = least(x.address, y.address) and q.b = greatest(x.address, y.address)))")
        self.components("fc", "select a, b from fe")
        return self.add("fw", "select vertex as loser, first_value(vertex) over (partition by component order by size desc, vertex) as winner from fc join p on p.cluster = vertex qualify loser <> winner")

    def enriched(self) -> Query:
        self.clustered().add("cr", "select * from c where cluster <> -1").best_address("eb", "cr", "cluster")
        yes = "coalesce(c.cluster <> -1 and coalesce(c.addr_street_name, '') = '' and c.addr_city = b.addr_city and c.addr_state = b.addr_state and c.addr_zip = b.addr_zip, false)"
        self.add("e1", f"select c.* exclude (addr_street_number, addr_street_name, addr_normalized_key), c.addr_normalized_key as old_key, {yes} as address_was_enriched, case when {yes} then b.addr_street_number else c.addr_street_number end as addr_street_number, case when {yes} then b.addr_street_name else c.addr_street_name end as addr_street_name from c left join eb b using (cluster)")
        return self.add("en", f"select * exclude (old_key), case when address_was_enriched then {ADDRESS_KEY} else old_key end as addr_normalized_key from e1")

    def mapped(self) -> Query:
        """m: the canonical map of the enriched records, their clusters as final ones."""
        self.enriched().add("fin", "select *, cluster as final_cluster from en").add("fr", "select * from fin where final_cluster <> -1")
        self.names("mn", "fr", "final_cluster").best_address("ma", "fr", "final_cluster")
        self.add("mp", "select final_cluster, avg(cluster_probability) as avg_cluster_prob from fr group by all")
        self.add("m0", "select *, dense_rank() over (partition by canonical_name order by addr_normalized_key) as k from (select n.final_cluster, n.canonical_name, a.* exclude (final_cluster, freq, score), p.avg_cluster_prob from mn n join ma a using (final_cluster) join mp p using (final_cluster))")
        return self.add("m", "select * replace (case when max(k) over (partition by canonical_name) > 1 then canonical_name || ' - ' || k else canonical_name end as canonical_name) from m0")

    def applied(self) -> Query:
        self.mapped()
        title = "array_to_string(list_transform(regexp_extract_all({0}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda w: upper(w[1:1]) || lower(w[2:])), '')".format("coalesce(m.canonical_name, f.normalized_text)")
        return self.add("ap", f"select f.*, {title} as canonical_name, coalesce(m.addr_normalized_key, f.addr_normalized_key) as canonical_address from fin f left join m using (final_cluster)")

    def confident(self) -> Query:
        self.applied().add("a0", "select *, lower(canonical_name) as lowered, lower(coalesce(company_name, '')) as entity from ap")
        self.scored("s1", "a0", "normalized_text", "lowered", "name_similarity").scored("s2", "s1x", "addr_normalized_key", "canonical_address", "address_confidence").scored("s3", "s2x", "entity", "lowered", "same")
        self.add("cm", "select final_cluster, count(normalized_text) as size, coalesce(stddev_samp(name_similarity), 0.0) as variation from s3x where final_cluster >= 0 group by all")
        self.add("s4", "select t.*, coalesce(cm.size, 1) as size, coalesce(greatest(0.0, least(1.0, 1.0 - variation)), 1.0) as cohesion, round(1.0 - same, 6) + 0.0 as change_magnitude from s3x t left join cm using (final_cluster)")
        w = CFG.scoring.weights
        base = f"(cluster_probability * {w['cluster_probability']} + name_similarity * {w['name_similarity']} + address_confidence * {w['address_confidence']} + cohesion * {w['cohesion_score']} + {SIZE_FACTOR} * {w['cluster_size_factor']})"
        base += " * case when change_magnitude > 0.5 then 0.9 else 1.0 end * case when address_was_enriched then 0.95 else 1.0 end * case when size <= 2 and change_magnitude > 0.7 then 0.85 else 1.0 end"
        self.add("s5", f"select *, round(greatest(0.0, least(1.0, case when final_cluster = -1 then name_similarity * 0.5 else {base} end)), 6) as confidence_score from s4")
        cat = "case when confidence_score <= 0.5 then 'Low' when confidence_score <= 0.7 then 'Medium' when confidence_score <= 0.85 then 'High' when confidence_score <= 1.0 then 'Very High' end"
        return self.add("sc", f"select *, {cat} as confidence_category from s5")

    def flagged(self) -> Query:
        self.confident()
        t = CFG.output.review_confidence_threshold
        reasons = f"concat_ws(',', case when confidence_score < {t} then 'low_confidence' end, case when change_magnitude > 0.7 then 'drastic_change' end, case when size = 1 and change_magnitude > 0.01 then 'single_member_change' end, case when address_was_enriched and confidence_score < 0.8 then 'enriched_low_conf' end)"
        return self.add("fl", f"select *, {reasons} as review_reason, {reasons} <> '' as needs_review from sc")


def parsed(line: str) -> str:
    """Columns of a parsed address line, for a select list over (rec_id, line)."""
    words = "|".join(STREET_WORDS)
    two = ", ".join(lit(w) for w in STREET_WORDS if len(w) == 2)
    cases = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in STREET_WORDS.items())
    return (
        "select rec_id, case when l <> '' then case when box <> '' then '' else number end end as addr_street_number,"
        " case when l <> '' then case when box <> '' then 'po box ' || box else written end end as addr_street_name,"
        " case when l <> '' then city end as addr_city, case when l <> '' then upper(st) end as addr_state, case when l <> '' then zip end as addr_zip from ("
        f" select *, case when street <> '' then substr(street, 1, length(street) - length(last)) || case last {cases} end else '' end as written from ("
        " select *, case when street <> '' then trim(substr(rest3, length(street) + 1)) else rest3 end as city, regexp_extract(street, '(\\S+)$', 1) as last from ("
        f" select *, regexp_extract(rest3, {lit(rf'^(.*\b(?:{words}))(?:\s|$)')}, 1) as street from ("
        f" select *, case when box <> '' then trim({sub('rest2', r'^p\s?o\s+box\s+\w+', '')}) else trim({sub('rest2', r'^\d+[a-z]?(?:\s|$)', '')}) end as rest3 from ("
        f" select *, regexp_extract(rest2, {lit(r'^p\s?o\s+box\s+(\w+)')}, 1) as box, regexp_extract(rest2, {lit(r'^(\d+[a-z]?)(?:\s|$)')}, 1) as number from ("
        f" select *, case when st <> '' then trim({sub('rest', r'(?:^|\s)[a-z]{2}$', '')}) else rest end as rest2 from ("
        f" select *, case when regexp_extract(rest, {lit(r'(?:^|\s)([a-z]{2})$')}, 1) in ({two}) then '' else regexp_extract(rest, {lit(r'(?:^|\s)([a-z]{2})$')}, 1) end as st from ("
        f" select *, regexp_extract(l, {lit(r'(?:^|\s)(\d{5})(?:-\d{4})?$')}, 1) as zip, trim({sub('l', r'(?:^|\s)\d{5}(?:-\d{4})?$', '')}) as rest from ("
        f" select rec_id, {squeezed(sub(f'lower({line})', r'[^\w\s#-]', ' '))} as l from e)))))))))"
    )
